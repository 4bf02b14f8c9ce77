"""Subjects of documents: interpolated bigram language models by subject against a background model.

Sentences of labelled documents train one model a subject and one of everything, all with absolute discounting and interpolation
bigram -> unigram -> background. A sentence deals with the subject whose model has the lowest cross-entropy a token on it, if that lies
below the background's by the subject's threshold, which is calibrated on documents held out. A document has every subject that at least a quarter of its sentences deal with.
Source code and configuration are software besides, and their names and comments are read as its sentences.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.session import spread

LABELLED = 20_000  # labelled documents at most that the models are trained on, by hash of the key
LABELLED_BYTES = 64 << 20  # bytes of their texts at most, in the same order
DISCOUNT = 1.5  # counts taken from every n-gram; what is seen once or twice says little
MIX = 0.6  # weight of the subject's own model in its mixture with the background
PRIOR = 20.0  # counts that the background's word pairs are worth in a subject's model
LEAST = 2  # documents that must hold a word
SOURCE = 0.5  # weight of what a document's source says of its subject
SMOOTH = 20.0
SHARE = 0.25
SOFTWARE, SCIENCE = "software", "science"

_TOKEN = re.compile(r"[A-ZÀ-Þ]?[a-zß-ÿĀ-ɏ]+|[A-ZÀ-Þ]+(?![a-zß-ÿ])|[^\W\d_a-zA-ZÀ-ÿ]+")
_BREAK = re.compile(r"(?<=[.!?…])\s+|(?<=[.!?…])[\"”»'’)]+\s+(?=[^a-zß-ÿ])|\n\s*(?=[^a-zß-ÿ\s])|\n\s*\n\s*")
_TAG = re.compile(r"<[^<>]*>")
_CODE_LINE = re.compile(r"[{}();=\[\]]|^\s*(?:#|//|--|\*|\w+:)|\w_\w", re.M)
_FORMULA = re.compile(r"\$|\\[a-zA-Z]+")
FORMULA = "$"  # stands first among the tokens of a sentence with formulas

# The names of languages that are source code or configuration.
CODE_LANGS = "python javascript java sql yaml json c cpp go rust ruby php html css shell bash toml ini xml typescript".split()


def looks_like_code(text: str) -> bool:
    """For records whose domain is unknown: most lines carry the punctuation of code and hardly any `$`."""
    lines = [x for x in text.split("\n") if x.strip()]
    return len(lines) > 1 and text.count("$") < 4 and sum(_CODE_LINE.search(x) is not None for x in lines) >= 0.7 * len(lines) and sum(text.count(c) for c in "{}()=_:") > len(text) / 60


def units(text: str, code: bool) -> list[list[str]]:
    """Tokens of each sentence; of code, of each line with names or comments."""
    if "<" in text and not code:
        text = _TAG.sub("\n", text)
    parts = text.split("\n") if code else _BREAK.split(text)
    out = []
    for part in parts:
        tokens = [w.lower() for w in _TOKEN.findall(part)] if part else []
        if tokens and not code and _FORMULA.search(part):
            tokens.insert(0, FORMULA)
        if tokens:
            out.append(tokens)
    return out


class Model:
    """Log-ratios of subject models to the background model, by word and by word pair."""

    def __init__(self, sentences: list[list[str]], owner: np.ndarray, subjects: int, document: np.ndarray, kind: np.ndarray) -> None:
        """owner[i] is the subject of sentence i or -1; every sentence is in the background."""
        self.subjects = subjects
        held: dict[str, set[int]] = defaultdict(set)
        for s, d in zip(sentences, document.tolist()):
            for w in s:
                if len(held[w]) < LEAST:
                    held[w].add(d)
        self.word = {w: i + 2 for i, w in enumerate(sorted(w for w, d in held.items() if len(d) >= LEAST))}  # 0 starts a sentence, 1 is any other word
        v, k = len(self.word) + 2, subjects + 1  # the last column is the background
        ids = [self.encode(s) for s in sentences]
        flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        before = np.concatenate([[0], flat[:-1]]) if len(flat) else flat
        if len(flat):
            before[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = 0
        who = np.repeat(owner, sizes)
        # sentences of a subject weigh so that every kind of text (language, style) has its overall part in each subject: what is
        # peculiar to a kind then tells nothing about the subject
        kinds = int(kind.max(initial=0)) + 1
        mass = np.zeros((kinds, k))
        per_token = np.repeat(kind, sizes)
        np.add.at(mass, (per_token, np.full(len(flat), subjects)), 1)
        np.add.at(mass, (per_token[who >= 0], who[who >= 0]), 1)
        scale = np.clip(mass[:, -1:] / np.maximum(mass, 1), 0, 60)
        weight = np.where(who >= 0, scale[per_token, who], 0)

        def tally(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
            """Weighted counts by row and subject, the last column the background's; and the same less the discount."""
            raw, full = np.zeros((n, k)), np.zeros((n, k))
            on = who >= 0
            np.add.at(raw, (rows, np.full(len(rows), subjects)), 1)
            np.add.at(raw, (rows[on], who[on]), 1)
            full[:, -1] = raw[:, -1]
            np.add.at(full, (rows[on], who[on]), weight[on])
            return full, full * np.maximum(raw - DISCOUNT, 0) / np.maximum(raw, 1)

        one, kept = tally(flat, v)
        total = np.maximum(one.sum(axis=0), 1)
        back = (one[:, -1] + 0.5) / (one[:, -1] + 0.5).sum()
        p1 = kept / total + (1 - kept.sum(axis=0) / total) * back[:, None]
        p1[:, -1] = back
        pair, place = np.unique(before * v + flat, return_inverse=True)
        two, kept = tally(place, len(pair))
        seen = two[:, -1] > DISCOUNT
        pair, two, kept = pair[seen], two[seen], kept[seen]
        context, _ = tally(before, v)
        h, w = pair // v, pair % v
        back2 = (two[:, -1] / context[h, -1])[:, None]
        used = np.zeros((v, k))
        np.add.at(used, h, kept)
        # a subject's pair model leans on the background's by PRIOR counts and by all that the discount took
        p2 = (kept + (PRIOR + context[h] - used[h]) * back2) / (context[h] + PRIOR)
        p2[:, -1:] = back2
        self.pair, self.v = pair, v

        def ratio(p: np.ndarray) -> np.ndarray:
            """Nats that the subject's model, itself interpolated with the background, saves or costs."""
            return np.log(MIX * p[:, :-1] / p[:, -1:] + 1 - MIX).astype(np.float32)

        self.of_pair, self.of_word = ratio(0.5 * p2 + 0.5 * p1[w]), ratio(p1)

    def verdicts(self, sentences: list[list[str]], prior: np.ndarray, science: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The subject whose model has the lowest cross-entropy on each sentence, and how far it lies below the background's, in nats a token.

        prior has the nats by which a sentence's source speaks for each subject. A sentence with formulas is science for sure.
        """
        gains = self.gains(sentences) + prior
        sizes = np.maximum(np.array([len(s) for s in sentences]), 1)
        top, best = gains.argmax(axis=1), gains.max(axis=1, initial=0) / sizes
        if science is not None:
            formula = np.array([s[0] == FORMULA for s in sentences], dtype=bool)
            top[formula], best[formula] = science, np.inf
        return top, best

    def encode(self, sentence: list[str]) -> np.ndarray:
        get = self.word.get
        return np.fromiter((get(w, 1) for w in sentence), dtype=np.int64, count=len(sentence))

    def gains(self, sentences: list[list[str]]) -> np.ndarray:
        """float[sentences, subjects]: nats by which the subject's model shortens the sentence."""
        sizes = np.array([len(s) for s in sentences], dtype=np.int64)
        if not len(sizes):
            return np.zeros((0, self.subjects), dtype=np.float32)
        get = self.word.get
        flat = np.fromiter((get(w, 1) for s in sentences for w in s), dtype=np.int64, count=int(sizes.sum()))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        before = np.concatenate([[0], flat[:-1]])
        before[starts] = 0
        key = before * self.v + flat
        each = self.of_word[flat]
        if len(self.pair):
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            met = self.pair[at] == key
            each[met] = self.of_pair[at[met]]
        each[flat == 1] = 0  # a word that training doesn't know says nothing
        return np.add.reduceat(each, starts, axis=0)


class Classifier:
    """Subject models, thresholds and the rule for documents."""

    def __init__(self, rows: list[tuple[str, str | None, str | None, str | None, set[str]]], subjects: list[str], rounds: int = 3) -> None:
        """rows: (text, domain, lang, source, labels) of each labelled document."""
        self.subjects = subjects
        number = {s: i for i, s in enumerate(subjects)}
        self.prior = self._priors([(r[3], {number[x] for x in r[4] if x in number}) for r in rows])
        sentences: list[list[str]] = []
        document, allowed, codes, kind = [], [], [], []
        kinds: dict[tuple, int] = {}
        for d, (text, domain, lang, _, labels) in enumerate(rows):
            code = self.is_code(text, domain, lang)
            codes.append(code)
            mine = {number[x] for x in labels if x in number}
            if code and len(mine) > 1:
                mine.discard(number.get(SOFTWARE, -1))
            clean = (lang or "").strip().lower().split("-")[0]
            own = units(text, code)
            letters, words = sum(len(w) for s in own for w in s), sum(map(len, own))
            style = ("$" in text, clean, code, int(letters / max(1, words) / 1.2))
            for s in own:
                sentences.append(s)
                document.append(d)
                allowed.append(mine)
                kind.append(kinds.setdefault(style, len(kinds)))
        doc, of_kind = np.array(document, dtype=np.int64), np.array(kind, dtype=np.int64)
        mask = np.zeros((len(sentences), len(subjects)), dtype=bool)
        for i, mine in enumerate(allowed):
            mask[i, list(mine)] = True
        owner = np.array([min(mine) if len(mine) == 1 else -1 for mine in allowed], dtype=np.int64)
        self.threshold, self.code_share = np.full(len(subjects), 0.05), SHARE  # nats a token; for want of labels
        self.model = Model(sentences, owner, len(subjects), doc, of_kind)
        for _ in range(rounds):
            gains = self.model.gains(sentences)
            best = np.where(mask, gains, -np.inf)
            top = best.argmax(axis=1) if len(sentences) else owner
            here, anywhere = best.max(axis=1, initial=-np.inf), gains.max(axis=1, initial=-np.inf)
            # a sentence trains a subject of its document if no other subject explains it better and it isn't general matter
            owner = np.where((here > 0.8) & (here >= anywhere - 0.5), top, -1)
            self.model = Model(sentences, owner, len(subjects), doc, of_kind)
        self._calibrate(rows, sentences, owner, doc, of_kind, np.array(codes, dtype=bool), number)

    def _calibrate(self, rows: list, sentences: list[list[str]], owner: np.ndarray, doc: np.ndarray, kind: np.ndarray, codes: np.ndarray, number: dict[str, int]) -> None:
        """The least entropy gain at which a sentence is taken for a subject, for each subject, and the share of code's lines: with the fewest
        errors against the labels of documents held out. Models of either half of the documents judge the other half."""
        if not len(sentences) or not self.subjects:
            return
        top, best = np.zeros(len(sentences), dtype=np.int64), np.zeros(len(sentences))
        for half in (0, 1):
            inside, out = np.flatnonzero(doc % 2 == half), np.flatnonzero(doc % 2 != half)
            if len(inside) and len(out):
                model = Model([sentences[i] for i in inside], owner[inside], len(self.subjects), doc[inside], kind[inside])
                prior = self._priors([(rows[d][3], {number[x] for x in rows[d][4] if x in number}) for d in range(half, len(rows), 2)])
                top[out], best[out] = model.verdicts([sentences[i] for i in out], self._prior_of([rows[d][3] for d in doc[out]], prior), number.get(SCIENCE))
        truth = np.zeros((len(rows), len(self.subjects)), dtype=bool)
        for d, (*_, labels) in enumerate(rows):
            truth[d, [number[x] for x in labels if x in number]] = True
        n = np.maximum(np.bincount(doc, minlength=len(rows)), 1)

        def taken(thresholds: np.ndarray) -> np.ndarray:
            hit = best >= thresholds[top]
            each = np.zeros((len(rows), len(self.subjects)))
            np.add.at(each, (doc[hit], top[hit]), 1)
            return each

        def errors(thresholds: np.ndarray) -> int:
            return ((taken(thresholds) >= SHARE * n[:, None]) != truth)[~codes].sum()

        def least(grid: np.ndarray, count: list[int]) -> float:
            good = grid[np.array(count) == min(count)]
            return float(good[len(good) // 2])

        grid = np.exp(np.linspace(np.log(0.005), 0.0, 25))
        self.threshold = np.full(len(self.subjects), least(grid, [errors(np.full(len(self.subjects), t)) for t in grid]))
        for k in range(len(self.subjects)):
            tried = np.repeat(self.threshold[None], len(grid), axis=0)
            tried[:, k] = grid
            self.threshold[k] = least(grid, [errors(t) for t in tried])
        if codes.any() and SOFTWARE in number:
            each = taken(self.threshold)
            shares, count = np.arange(0.1, 0.7, 0.05), []
            for c in shares:
                got = each >= c * np.maximum(each.sum(axis=1), 1)[:, None]
                got[:, number[SOFTWARE]] = True
                count.append((got != truth)[codes].sum())
            self.code_share = least(shares, count)

    def _priors(self, labelled: list[tuple[str | None, set[int]]]) -> dict[str, np.ndarray]:
        """Log-ratios of the subjects' parts in each source to their parts in all, SMOOTH labels of the latter added to a source."""
        count: dict[str | None, np.ndarray] = defaultdict(lambda: np.zeros(len(self.subjects)))
        for source, mine in labelled:
            for k in mine:
                count[source][k] += 1
        part = sum(count.values(), np.zeros(len(self.subjects))) + 1
        part /= part.sum()
        return {s: SOURCE * np.log((c + SMOOTH * part) / (c.sum() + SMOOTH) / part) for s, c in count.items() if s is not None}

    def _prior_of(self, sources: list[str | None], prior: dict[str, np.ndarray]) -> np.ndarray:
        none = np.zeros(len(self.subjects))
        return np.array([prior.get(s, none) for s in sources]).reshape(len(sources), len(self.subjects))

    @staticmethod
    def is_code(text: str, domain: str | None, lang: str | None) -> bool:
        if domain is not None:
            return domain == "code"
        clean = (lang or "").strip().lower().split("-")[0]
        return clean in CODE_LANGS if clean else looks_like_code(text)

    def classify(self, texts: list[str | None], domains: list[str | None], langs: list[str | None], sources: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, subject, share) of every subject of every document."""
        sentences: list[list[str]] = []
        sizes, codes = [], []
        for text, domain, lang in zip(texts, domains, langs):
            code = text is not None and self.is_code(text, domain, lang)
            own = units(text, code) if text else []
            sentences += own
            sizes.append(len(own))
            codes.append(code)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        each = np.zeros((len(sizes), len(self.subjects)))
        if len(sentences):
            prior = np.repeat(self._prior_of(sources, self.prior), sizes, axis=0)
            top, best = self.model.verdicts(sentences, prior, self.subjects.index(SCIENCE) if SCIENCE in self.subjects else None)
            hit = best >= self.threshold[top]
            np.add.at(each, (doc[hit], top[hit]), 1)
        code = np.array(codes, dtype=bool)
        n = np.where(code, each.sum(axis=1), np.array(sizes))
        share = each / np.maximum(n, 1)[:, None]
        got = np.where(code[:, None], (share >= self.code_share), share >= SHARE) & (each > 0)
        if SOFTWARE in self.subjects:
            k = self.subjects.index(SOFTWARE)
            got[:, k] |= code & (np.array(sizes) > 0)
            share[code, k] = 1.0
        d, s = np.nonzero(got)
        return d, s, share[d, s]


def train(records: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", labelled: int = LABELLED, labelled_bytes: int = LABELLED_BYTES) -> Classifier:
    """The classifier, trained on the driver from at most `labelled` labelled documents of at most labelled_bytes in all, chosen by hash of the key."""
    named = labels.select(labels[key].cast("bigint").alias("k"), labels["subject"].alias("subject")).where("k IS NOT NULL AND subject IS NOT NULL")
    chosen = named.groupBy("k").agg(F.collect_set("subject").alias("subjects")).orderBy(F.xxhash64("k")).limit(labelled)  # a key and its few subjects a row
    rows = records.select(records[key].cast("bigint").alias("k"), "text", "domain", "lang", "source").where("text IS NOT NULL")
    known = rows.join(F.broadcast(chosen), "k").dropDuplicates(["k"])
    read = F.sum(F.octet_length("text")).over(W.orderBy(F.xxhash64("k"), "k"))  # of `labelled` rows at most
    known = known.withColumn("read", read).where(F.col("read") <= labelled_bytes).orderBy("k").collect()
    names = [r.subject for r in subjects.where("subject IS NOT NULL").select("subject").distinct().orderBy("subject").collect()]
    return Classifier([(r.text, r.domain, r.lang, r.source, set(r.subjects)) for r in known], names)


def document_subjects(records: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", labelled: int = LABELLED) -> DataFrame:
    """(key, subject, share) of every subject that a record's text is about; share is that of its sentences.

    Null keys and texts, empty and blank texts, and texts about no subject give no row; records written again count once; very long
    texts are read whole; without labels only the rule for code holds; an empty table gives an empty result; other columns are ignored.
    Code has share 1 of software, the shares of its other subjects are of its lines that deal with any subject.
    """
    model = train(records, labels, subjects, key, labelled)
    # bounded by `labelled`; as bytes, so that workers need no copy of this package
    held = records.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    rows = records.select(records[key].cast("bigint").alias("k"), records["text"].alias("t"), records["domain"].cast("string").alias("d"), records["lang"].cast("string").alias("l"), records["source"].cast("string").alias("s")).where("k IS NOT NULL AND t IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = cloudpickle.loads(held.value)
        names = np.array(found.subjects, dtype=object)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                d, s, share = found.classify(*(batch.column(c).to_pylist() for c in (1, 2, 3, 4)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array(names[s], type=pa.string()) if len(s) else pa.array([], type=pa.string()), pa.array(share)], names=[key, "subject", "share"])

    return spread(rows).mapInArrow(run, f"`{key}` bigint, subject string, share double").dropDuplicates([key, "subject"])
