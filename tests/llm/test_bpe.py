import os
import random

import pyarrow as pa
import pytest

from millrace.llm import bpe

PATH = f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")
SCHEMA = "doc_id bigint, text string, ids string, slot string"


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    own.encode_special_tokens = True
    return lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def test_fragments_equal_whole_texts(whole):
    encoder = bpe.FragmentEncoder(PATH)
    random.seed(4)
    alphabet = "abcZ 's'ré  \n\t  12٣½中文<|endoftext|>'ll!?…é́\U0001f600   \x85\x1c'' 've//**"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(8000)]
    assert bpe.encode_column(pa.array(texts), encoder).to_pylist() == whole(texts)


def test_edges(spark, whole):
    long = "word, éé 'tis\n" * 20_000 + "q" * 3000
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (3, " \n ", "x", "y"), (4, long, "x", "y"), (5, "<|endoftext|>", "x", "y"), (5, "<|endoftext|>", "x", "y"), (None, "a", "x", "y")]
    got = bpe.encode_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    for (k, t, _, _), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r.doc_id, next(x[1] for x in rows if x[0] == r.doc_id), "x", "y")))):
        assert r.doc_id == k and r.ids == whole([t or ""])[0]
    assert bpe.encode_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cache_starts_anew(monkeypatch, whole):
    monkeypatch.setattr(bpe, "_CACHE", 3)
    monkeypatch.setattr(bpe, "_SLICE", 16)
    texts = ["alpha beta", "gamma delta", "alpha beta", None, "x" * 100] * 3
    found = []
    encoder = bpe.FragmentEncoder(PATH)
    for raw, offsets in bpe.text_slices(pa.array(texts, type=pa.string()), 16):
        ids, ends = encoder(raw, offsets)
        found += [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
    assert found == whole([t or "" for t in texts])
