"""Quality classifier: weak labels and a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or nothing on every document, once for quality and once for toxicity; the
given labels, where there are any, are one more labeller. Expectation-maximisation over the counts of vote patterns
(of all documents; 3 to the number of labellers patterns at most) estimates each labeller's accuracy and the posterior
of each pattern. The posteriors of a bounded sample of labelled rows (``train_rows``) train two linear scorers on hashed
features: shares of word shapes and repeats for quality, presence of words and word beginnings for toxicity. The
scorers then judge every document.

Defined results: a null text is empty; a document without words is rejected with quality 0; texts count whole; repeated
rows are judged alike; with no labels (or none that match) the heuristics alone train, on a sample of all rows; an
empty table gives an empty table; ``classify`` keeps all columns, and its outputs replace columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import arrow_map, release, split_words

#: Rows that train the scorers, at most: those of the lowest hash among the labelled ones.
TRAIN_ROWS = 6000
#: Documents (of the sample) that a hashed feature must occur in to get a weight.
SUPPORT = 3
LEXICON = ("idiot", "moron", "loser", "clown", "scum", "trash", "stupid", "pathetic", "worthless", "disgusting", "imbecile", "bastard", "filth", "vermin", "retard", "slut", "whore", "bitch", "asshole", "fuck", "shit", "cunt")
GOOD, BAD, NONE = 1, 2, 0
QUALITY_LABELLERS = ("symbols", "capitals", "bars", "exclamations", "repeats", "ends", "label")
TOXIC_LABELLERS = ("lexicon", "terms", "label")
SHAPES = 1 << 12
SCALE = 10.0

_CLASS = np.zeros(256, np.uint16)  # bits of a word's shape, by byte
for _bit, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~", b"|", b"!?", b".,;:", b"\"'()-", b"<>{}[]=+_/\\`", bytes(range(128, 256)))):
    _CLASS[[*_bytes]] |= 1 << _bit
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TRIM = np.zeros(256, bool)
_TRIM[[*b".,;:!?\"'()#$%&*|"]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1 << 12, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.ones(2 * n, np.uint64)
    if _POWERS[1] != _P:
        _POWERS[1:] = _P
        np.multiply.accumulate(_POWERS, out=_POWERS)
    return _POWERS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return ((x ^ (x >> np.uint64(33))) >> np.uint64(32)).astype(np.int64)


@dataclass
class Words:
    """The words of some texts: of each distinct word its shape and hashes, and the texts' words in order."""

    code: np.ndarray  # of every word
    rows: np.ndarray  # n+1 offsets
    shape: np.ndarray
    hashes: np.ndarray  # distinct words by (word, first 4 bytes, first 6 bytes), each a 32-bit bucket
    ends: np.ndarray  # whether the word ends a sentence

    @classmethod
    def of(cls, texts: pa.Array, trim: np.ndarray = _TRIM) -> Words:
        code, distinct, rows = split_words(texts)
        n = len(distinct)
        offsets = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + n + 1] if n else np.zeros(1, np.int64)
        flat = np.frombuffer(distinct.buffers()[2], np.uint8)[: offsets[-1]] if n else np.zeros(0, np.uint8)
        if not n:
            return cls(code, rows, np.zeros(0, np.int64), np.zeros((0, 3), np.int64), np.zeros(0, bool))
        start, length = offsets[:-1], np.diff(offsets)
        bits = np.bitwise_or.reduceat(_CLASS[flat], start).astype(np.int64)
        first = _CLASS[flat[start]].astype(np.int64)
        capital = ((first & 2) > 0) & ((bits & 1) > 0)
        bits = np.where(capital, (bits & ~2) | 1 << 10, bits) | np.where(length == 1, 1 << 11, 0)
        ends = np.isin(flat[offsets[1:] - 1], [*b".!?"])
        # letters only, lower-cased: bytes up to the last that isn't trimmed
        within = np.arange(len(flat)) - np.repeat(start, length)
        kept = np.where(trim[flat], 0, within + 1)
        size = np.maximum.reduceat(kept, start)
        low = np.where(within < np.repeat(size, length), _LOWER[flat], 0).astype(np.uint64)
        powers = _powers(int(length.max()) + 1)
        whole = np.add.reduceat((low + np.uint64(1)) * powers[within] * (low > 0), start)
        part = lambda k: np.add.reduceat((low + np.uint64(1)) * powers[within] * ((low > 0) & (within < k)), start) + np.uint64(k)
        hashes = np.stack([_mix(whole), np.where(size >= 4, _mix(part(4)), -1), np.where(size >= 6, _mix(part(6)), -1)], 1)
        hashes[size == 0] = -1
        return cls(code, rows, bits, hashes, ends)

    def share(self, of_word: np.ndarray) -> np.ndarray:
        """The share of each text's words that have the property; 0 for a text without words."""
        return self.sums(of_word[self.code]) / np.maximum(1, np.diff(self.rows))

    def sums(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
        return total[self.rows[1:]] - total[self.rows[:-1]]

    def repeats(self) -> np.ndarray:
        """The share of words that equal the word before them."""
        same = np.zeros(len(self.code), bool)
        same[1:] = self.code[1:] == self.code[:-1]
        same[self.rows[:-1][self.rows[:-1] < len(same)]] = False
        return self.sums(same) / np.maximum(1, np.diff(self.rows))

    def present(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, place in ``buckets``) pairs; buckets: sorted."""
        if not len(buckets) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(buckets, self.hashes), len(buckets) - 1)
        at = np.where(buckets[at] == self.hashes, at, -1)
        hit = (at >= 0).any(1)
        words = np.flatnonzero(hit[self.code])
        text = np.searchsorted(self.rows, words, side="right") - 1
        found = at[self.code[words]]
        pairs = np.stack([np.repeat(text, 3), found.ravel()], 1)
        pairs = np.unique(pairs[pairs[:, 1] >= 0], axis=0)
        return pairs[:, 0], pairs[:, 1]

    def shapes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, shape, share of the text's words); shape SHAPES is a repeat."""
        n = len(self.rows) - 1
        text = np.repeat(np.arange(n), np.diff(self.rows))
        key, count = np.unique(text * (SHAPES + 1) + self.shape[self.code], return_counts=True)
        own = key // (SHAPES + 1)
        share = count / np.diff(self.rows)[own]
        rep = self.repeats()
        return np.concatenate([own, np.arange(n)]), np.concatenate([key % (SHAPES + 1), np.full(n, SHAPES)]), np.concatenate([share, rep])


def _hash_words(words: Iterable[str]) -> np.ndarray:
    listed = Words.of(pa.array([" ".join(words)]))
    return np.unique(listed.hashes[:, 0])


def _vote(x: np.ndarray, good: float, bad: float) -> np.ndarray:
    """Good below ``good``, bad from ``bad`` on, else nothing."""
    return np.where(x >= bad, BAD, np.where(x < good, GOOD, NONE))


def quality_votes(words: Words) -> np.ndarray:
    """Votes on quality of all labellers but the given labels, as a number in base 3 for each text."""
    some = np.diff(words.rows) > 0
    shape = words.shape
    shouted = ((shape & 2) > 0) & ((shape & 1) == 0)
    votes = [
        _vote(words.share((shape & 8) > 0), 0.1, 0.3),
        _vote(words.share(shouted & ((shape & 1 << 11) == 0)), 0.2, 0.5),
        _vote(words.share((shape & 16) > 0), 0.05, 0.2),
        _vote(words.share((shape & 32) > 0), 0.1, 0.3),
        _vote(words.repeats(), 0.15, 0.4),
        np.where(words.share(words.ends) >= 0.01, GOOD, NONE),
    ]
    return sum(np.where(some, v, BAD) * 3**i for i, v in enumerate(votes))


def toxic_votes(hits: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The same on toxicity, from how many words of the lexicon and of the terms each text has."""
    return np.where(hits > 0, BAD, GOOD) + 3 * np.where(known >= 2, BAD, np.where(known == 0, GOOD, NONE))


def heuristic_votes(words: Words, terms: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes on quality and toxicity."""
    n = len(words.rows) - 1
    return quality_votes(words), toxic_votes(np.bincount(words.present(lexicon)[0], minlength=n), np.bincount(words.present(terms)[0], minlength=n))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of BAD of each pattern, each labeller's P(vote | class) as (labellers, class, vote), and the prior of BAD.

    Votes are conditionally independent given the class. It starts from the majority and keeps the classes' meaning: a
    pattern with only good votes starts as good.
    """
    votes = np.stack([patterns // 3**i % 3 for i in range(labellers)], 1) if len(patterns) else np.zeros((0, labellers), int)
    bad, good = (votes == BAD).sum(1), (votes == GOOD).sum(1)
    post = np.where(bad > 0, np.clip((2.0 * bad) / np.maximum(1, 2 * bad + 0.5 * good), 0.5, 0.95), 0.02)
    table = np.full((labellers, 2, 3), 1 / 3)
    prior = 0.1
    for _ in range(rounds):
        total = np.stack([counts * (1 - post), counts * post])
        prior = (total[1].sum() + 1) / (total.sum() + 10)
        for j in range(labellers):
            for c in (0, 1):
                t = np.bincount(votes[:, j], weights=total[c], minlength=3) + (0.5, 0.5, 0.5)
                table[j, c] = t / t.sum()
        logit = np.log(prior / (1 - prior)) + sum(np.log(table[j, 1, votes[:, j]] / table[j, 0, votes[:, j]]) * (votes[:, j] != NONE) for j in range(labellers))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return post, table, float(prior)


def fit_linear(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, columns: int, l1: float, l2: float, positive: bool, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights and intercept by accelerated proximal gradient, on soft labels."""
    n = max(1, len(y))
    mul = lambda w: np.bincount(row, weights=value * w[col], minlength=len(y))
    back = lambda r: np.bincount(col, weights=value * r[row], minlength=columns)
    v = np.ones(columns) / max(1, columns) ** 0.5
    top = 1.0
    for _ in range(15):
        u = back(mul(v)) / n
        top = np.linalg.norm(u) or 1.0
        v = u / top
    step = 1 / (0.25 * (top + 1) * 1.2 + l2)
    base = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    w, b = np.zeros(columns), float(np.log(base / (1 - base)))
    pw, pb, t = w, b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-np.clip(mul(pw) + pb, -30, 30))) - y
        nw = pw - step * (back(r) / n + l2 * pw)
        nw = np.maximum(0, nw - step * l1) if positive else np.sign(nw) * np.maximum(0, np.abs(nw) - step * l1)
        nb = pb - step * r.sum() / n
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


@dataclass
class Model:
    """Fitted scorers; its size is bounded by the sample's."""

    shape_weight: np.ndarray
    shape_bias: float
    bucket: np.ndarray
    bucket_weight: np.ndarray
    toxic_bias: float
    accuracies: dict[str, list[list[float]]] = field(default_factory=dict)

    def score(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """P(good quality) and P(toxic)."""
        n = len(words.rows) - 1
        text, shape, share = words.shapes()
        z = np.bincount(text, weights=share * SCALE * self.shape_weight[shape], minlength=n) + self.shape_bias
        quality = 1 / (1 + np.exp(np.clip(z, -30, 30)))
        quality[np.diff(words.rows) == 0] = 0.0
        text, at = words.present(self.bucket)
        # a word and its beginnings are one piece of evidence in training and here: weights just add
        z = np.bincount(text, weights=self.bucket_weight[at], minlength=n) + self.toxic_bias
        return quality, 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame | None, id_column: str, column: str, rows: int) -> list:
    """Features of the sample: votes on quality, hash buckets, shapes and shares, and the given labels."""
    order = F.xxhash64(F.lit("quality"), F.col("id"))
    own = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{column}`").alias("text"))
    if labels is not None:
        chosen = labels.withColumn("o", order).orderBy("o", "id").limit(rows)
        own = own.join(F.broadcast(chosen), "id")
    else:
        own = own.withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int"), "o": order}).orderBy("o", "id").limit(rows)

    def run(part: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        words = Words.of(part.column(0))
        n = part.num_rows
        text = np.repeat(np.arange(n), np.diff(words.rows))
        pairs = np.unique(np.stack([np.repeat(text, 3), words.hashes[words.code].ravel()], 1), axis=0) if len(text) else np.zeros((0, 2), np.int64)
        pairs = pairs[pairs[:, 1] >= 0]
        own, shape, share = words.shapes()
        order = np.argsort(own, kind="stable")
        at, cut = np.searchsorted(pairs[:, 0], np.arange(n + 1)), np.searchsorted(own[order], np.arange(n + 1))
        lists = lambda values, bounds, t: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, t))
        yield pa.RecordBatch.from_arrays(
            [part.column(1), part.column(2), part.column(3), part.column(4), pa.array(quality_votes(words), pa.int32()), lists(pairs[:, 1], at, pa.int64()), lists(shape[order], cut, pa.int32()), lists(share[order], cut, pa.float64())],
            ["o", "id", "quality", "toxic", "votes", "buckets", "shapes", "shares"],
        )

    kind = docs.schema[id_column].dataType.simpleString()
    features = arrow_map(own.select("text", "o", F.col("id"), F.col("quality").cast("int"), F.col("toxic").cast("int")), run, f"o long, id {kind}, quality int, toxic int, votes int, buckets array<long>, shapes array<int>, shares array<double>")
    return features.orderBy("o", "id").limit(rows).toArrow()


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each element, and the elements."""
    column = column.combine_chunks()
    lengths = np.asarray(pa.compute.list_value_length(column), dtype=np.int64)
    return np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), np.asarray(column.flatten())


def fit(docs: DataFrame, labels: DataFrame | None = None, id_column: str = "doc_id", column: str = "text", train_rows: int = TRAIN_ROWS, lexicon: Iterable[str] = LEXICON) -> Model:
    """Vote on all documents, estimate the labellers, and train the scorers on at most ``train_rows`` rows."""
    kind = docs.schema[id_column].dataType.simpleString()
    given = None
    if labels is not None:
        given = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).groupBy("id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    sample = _sample(docs, given, id_column, column, train_rows)
    if given is not None and not sample.num_rows:
        given, sample = None, _sample(docs, None, id_column, column, train_rows)

    def label_votes(name: str, bad: int) -> np.ndarray:
        x = pa.compute.fill_null(sample.column(name), -1).to_numpy() if sample.num_rows else np.zeros(0, int)
        return np.where(x == bad, BAD, np.where(x == 1 - bad, GOOD, NONE))

    bucket_row, bucket = _flat(sample.column("buckets"))
    toxic_label = label_votes("toxic", 1)
    distinct, place = np.unique(bucket, return_inverse=True)
    place = place.astype(np.int32)
    # the half of the sample with even places names the terms, so that the other half tells how good they are
    half = bucket_row % 2 == 0
    h_bad = np.bincount(place, weights=half & (toxic_label[bucket_row] == BAD), minlength=len(distinct))
    h_good = np.bincount(place, weights=half & (toxic_label[bucket_row] == GOOD), minlength=len(distinct))
    terms = distinct[(h_bad >= SUPPORT) & (h_bad >= 0.75 * (h_bad + h_good))]
    listed = _hash_words(lexicon)

    def vote(part: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        q, t = heuristic_votes(Words.of(part.column(1)), terms, listed)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(q, pa.int32()), pa.array(t, pa.int32())], ["id", "q", "t"])

    votes = arrow_map(docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{column}`").alias("text")), vote, f"id {kind}, q int, t int")
    if given is not None:
        votes = votes.join(given, "id", "left")
        gold = lambda c, bad: F.when(F.col(c) == bad, BAD).when(F.col(c) == 1 - bad, GOOD).otherwise(NONE)
        votes = votes.select((F.col("q") + gold("quality", 0) * 3 ** (len(QUALITY_LABELLERS) - 1)).alias("q"), (F.col("t") + gold("toxic", 1) * 3 ** (len(TOXIC_LABELLERS) - 1)).alias("t"))
    counted = votes.groupBy("q", "t").count().toPandas()  # at most 3^10 rows
    posts, accuracies = [], {}
    for c, names in (("q", QUALITY_LABELLERS), ("t", TOXIC_LABELLERS)):
        by = counted.groupby(c)["count"].sum()
        patterns, counts = by.index.to_numpy(np.int64), by.to_numpy(np.float64)
        post, tables, _ = expectation_maximisation(patterns, counts, len(names))
        accuracies |= {f"{c}:{name}": tables[j].tolist() for j, name in enumerate(names)}
        posts.append(dict(zip(patterns.tolist(), post.tolist())))

    # the sample's own patterns: the votes that these rows cast among all documents
    n = sample.num_rows
    own_q = sample.column("votes").to_numpy().astype(np.int64)
    own_t = toxic_votes(np.bincount(bucket_row, weights=np.isin(bucket, listed), minlength=n), np.bincount(bucket_row, weights=np.isin(bucket, terms), minlength=n))
    own_q = own_q + label_votes("quality", 0) * 3 ** (len(QUALITY_LABELLERS) - 1)
    own_t = own_t + toxic_label * 3 ** (len(TOXIC_LABELLERS) - 1)
    y_q = np.array([posts[0][p] for p in own_q.tolist()])
    y_t = np.array([posts[1][p] for p in own_t.tolist()])

    row, shape = _flat(sample.column("shapes"))
    share = _flat(sample.column("shares"))[1].astype(np.float64)
    shape_weight, shape_bias = fit_linear(row, shape.astype(np.int64), share * SCALE, y_q, SHAPES + 1, 1e-4, 1e-3, False)
    soft_bad = np.bincount(place, weights=y_t[bucket_row], minlength=len(distinct))
    usable = np.flatnonzero((soft_bad >= SUPPORT) & (soft_bad >= 0.5 * (np.bincount(place, minlength=len(distinct)))))
    to = np.full(len(distinct), -1)
    to[usable] = np.arange(len(usable))
    keep = to[place] >= 0 if len(place) else np.zeros(0, bool)
    row, col = bucket_row[keep], to[place[keep]]
    w, _ = fit_linear(row, col, np.ones(len(row)), y_t, len(usable), 1e-4, 0, True)
    chosen = np.flatnonzero(w > 1e-3)
    to2 = np.full(len(usable), -1)
    to2[chosen] = np.arange(len(chosen))
    keep = to2[col] >= 0 if len(col) else np.zeros(0, bool)
    w, b = fit_linear(row[keep], to2[col[keep]], np.ones(int(keep.sum())), y_t, len(chosen), 0, 1e-4, True)
    del sample, bucket, bucket_row, place, row, col, keep, half
    release()
    return Model(shape_weight, shape_bias, distinct[usable[chosen]], w, b, accuracies)


def classify(docs: DataFrame, model: Model, column: str = "text", quality: float = 0.5, toxic: float = 0.35) -> DataFrame:
    """All columns, and quality_score, toxic_score, keep (good enough and not toxic)."""
    kept = [f for f in docs.schema.fields if f.name not in {"quality_score", "toxic_score", "keep"}]
    schema = T.StructType([*kept, T.StructField("quality_score", T.DoubleType()), T.StructField("toxic_score", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    at = [f.name for f in kept].index(column)

    def run(part: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        q, t = model.score(Words.of(part.column(at)))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(q), pa.array(t), pa.array((q >= quality) & (t < toxic))], schema.fieldNames())

    return arrow_map(docs.select(*[f"`{f.name}`" for f in kept]), run, schema, column)


def judge(docs: DataFrame, labels: DataFrame | None = None, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """id, quality_score, toxic_score, keep of every document."""
    model = fit(docs, labels, id_column, column)
    return classify(docs.select(f"`{id_column}`", f"`{column}`"), model, column).drop(column)


def kept(docs: DataFrame, labels: DataFrame | None = None, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    names = docs.columns
    model = fit(docs, labels, id_column, column)
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    judged = classify(inner, model, f"c{names.index(column)}").filter("keep")
    return judged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
