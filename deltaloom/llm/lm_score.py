"""Cross-entropy difference of a target and a background bigram model.

Both models are of one order, one smoothing and one vocabulary: all words of
the background and of the target. A document's score is the mean, over its
tokens, of the target model's loss less the background model's; the lower, the
more like the target.

*Counting.* Texts are dealt by hash to homes of a few MB. A home adds up its
words, its followed words and its bigrams, each known by a 64-bit hash, and
sends every sum to the group its hash belongs to. A group adds up what all homes
sent and answers each with the counts of the entries it asked for, with which
the home scores its documents. An entry is sent once by a home however often it
occurs there, so neither a frequent bigram nor a large table fills one task, and
nothing that grows with the input is broadcast or sent to the driver. Only a
home's groups that hold one of its entries are asked; the sizes of the models
(words of each side and of the vocabulary) are counted before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructField, StructType

from .common import freed, lean, slices, spread
from .suffix_dedup import _Hasher, _mix

#: Bytes of text of a home, and of a group's share of the counts; bytes of text hashed at once.
HOME, PART = 8 << 20, 1 << 19
#: The hash that stands for the start of a document.
START = 1
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ASK = "home long, group long, size long, key binary, n binary, m binary"
_ANSWER = "home long, group long, size long, n binary, m binary"


def _coded(x) -> bytes:
    """An array byte plane by byte plane, compressed: small numbers take little room."""
    import numpy as np

    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), asbytes=True)


def _decoded(blob: bytes, size: int, kind: str):
    import numpy as np

    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob, size * width, asbytes=True), np.uint8).reshape(width, size)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _words(texts: list[bytes]):
    """Hashes of the words of ``texts``, A-Z lower-cased, and the number of the text of each."""
    import numpy as np

    space, lower = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
    space[[0x20, *range(0x09, 0x0E)]] = True
    lower[65:91] += 32
    laid = b" ".join(texts)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    hashes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    at = 0
    while at < len(laid):
        # A part ends at white space.
        cut = _SPACE.search(laid, min(at + PART, len(laid)))
        stop = cut.start() if cut else len(laid)
        raw = lower[np.frombuffer(laid, np.uint8, stop - at, at)]
        edge = np.diff((~space[raw]).astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        hashes.append(_Hasher(raw).of(first, last))
        places.append(first + at)
        at = stop + 1
    return np.concatenate(hashes), np.searchsorted(begin, np.concatenate(places), side="right") - 1


class _Entries:
    """What a home counts and asks for: its words, its followed words and its bigrams, in the order of their keys. Groups are ranges of keys."""

    def __init__(self, texts: list[bytes], groups: int):
        import numpy as np

        words, self.text = _words(texts)
        self.words, word = np.unique(words, return_inverse=True)
        k = len(self.words)
        before = np.full(len(word), k)
        before[1:] = np.where(self.text[1:] == self.text[:-1], word[:-1], k)
        pairs, self.pair = np.unique(before * (k + 1) + word, return_inverse=True)
        self.before, self.word = pairs // (k + 1), pairs % (k + 1)
        v = np.append(self.words, np.uint64(START))
        follow, pair = _mix(v ^ np.uint64(0x5851F42D4C957F2D)), _mix(_mix(v[self.before] + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(3) + v[self.word])
        # Words have odd keys, the others even ones.
        key = np.concatenate([self.words | np.uint64(1), follow & ~np.uint64(1), pair & ~np.uint64(1)])
        self.order = np.argsort(key)
        self.key = key[self.order]
        group = ((self.key >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
        self.cuts = np.searchsorted(group, np.arange(groups + 1))
        self.all_words, self.all_before = word, before

    def counts(self, of_text):
        """Occurrences of the entries in the texts that ``of_text`` says."""
        import numpy as np

        taken, k = of_text[self.text], len(self.words)
        parts = ((self.all_words, k), (self.all_before, k + 1), (self.pair, len(self.before)))
        return np.concatenate([np.bincount(x[taken], minlength=n)[:n] for x, n in parts])[self.order].astype("<u4")

    def split(self, answered):
        """Of a value for each entry: those of the bigrams, of the words they begin with, and of the words they end with."""
        import numpy as np

        value, k = np.empty(len(answered), answered.dtype), len(self.words)
        value[self.order] = answered
        return value[2 * k + 1 :], value[k : 2 * k + 1][self.before], value[:k][self.word]


def fit(background: DataFrame, target: DataFrame, text: str = "text", weight: float = 0.75) -> dict:
    """The two models: what they are counted from. ``score`` counts them along with the documents.

    Counts are of all rows and all words. The vocabulary is the words that
    occur in the background or in the target, and one more for all others.
    p(w | v) = weight * c(v, w) / c(v) + (1 - weight) * (c(w) + 1) / (N + V),
    with each model's own counts; v may be the start of a document. A bigram or
    word that one side lacks keeps its count of the other.
    """
    return {"background": background, "target": target, "text": text, "weight": weight}


def _sizes(rows: DataFrame) -> tuple[int, int, int]:
    """Words of the background and of the target, and distinct words of both."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in (some for batch in batches for some in slices(batch, "raw", HOME)):
            words, text = _words(batch.column("raw").to_pylist())
            words, at = np.unique(words, return_inverse=True)
            sums = [np.bincount(at[batch.column(side).to_numpy(zero_copy_only=False)[text]], minlength=len(words)) for side in ("background", "target")]
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), *(pa.array(x, pa.int64()) for x in sums)], names=["word", "n", "m"])

    words = rows.select("raw", "background", "target").mapInArrow(count, "word long, n long, m long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    total = words.agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.count_if((F.col("n") > 0) | (F.col("m") > 0)).alias("v")).first()
    return total.n or 0, total.m or 0, total.v


def _dealt(df: DataFrame, text: str, others, background: bool, target: bool) -> DataFrame:
    """(others, raw, background, target, spread): spread is a hash of all columns, so that copies of a text are dealt apart."""
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    return df.select(others.alias("others"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("raw"), F.lit(background).alias("background"), F.lit(target).alias("target"), F.xxhash64(*plain).alias("spread"))


def score(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with n_tokens, loss_background, loss_target and score, the last three per token.

    score = loss_target - loss_background; null for documents without words
    (null, empty, white space), with n_tokens 0. Columns of these names are
    replaced; repeated rows are scored alike. Where ``docs`` is the background
    itself, its texts are read once for both.
    """
    import numpy as np

    names = ("n_tokens", "loss_background", "loss_target", "score")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    background, target, weight = model["background"], model["target"], model["weight"]
    same = docs is background and text == model["text"]
    kind = docs.select(*keep).schema
    none = F.lit(None).cast(kind)
    rows = _dealt(docs, text, F.struct(*keep), same, False).unionByName(_dealt(target, model["text"], none, False, True))
    if not same:
        rows = rows.unionByName(_dealt(background, model["text"], none, True, False))
    groups = max(1, -(-(rows.agg(F.sum(F.length("raw"))).first()[0] or 0) // HOME))
    all_n, all_m, size = _sizes(rows)
    rows = rows.withColumn("home", F.pmod("spread", F.lit(groups))).drop("spread")

    def entries(texts: pa.Table) -> _Entries:
        return _Entries(texts.column("raw").to_pylist(), groups)

    def ask(texts: pa.Table) -> pa.Table:
        freed()
        e = entries(texts)
        n, m = (e.counts(texts.column(side).to_numpy()) for side in ("background", "target"))
        # Keys are sent as differences.
        asked = np.flatnonzero(np.diff(e.cuts))
        parts = [slice(s, t) for s, t in zip(e.cuts[asked].tolist(), e.cuts[asked + 1].tolist())]
        key = [_coded(np.diff(e.key[x], prepend=np.uint64(0))) for x in parts]
        home = texts.column("home")[0].as_py()
        columns = {"home": pa.array([home] * len(asked), pa.int64()), "group": pa.array(asked, pa.int64()), "size": pa.array(np.diff(e.cuts)[asked], pa.int64())}
        return pa.table(columns | {c: pa.array(x, pa.binary()) for c, x in zip(("key", "n", "m"), (key, *([_coded(y[x]) for x in parts] for y in (n, m))))})

    def answer(asked: pa.Table) -> pa.Table:
        freed()
        sizes = asked.column("size").to_pylist()
        keys = [np.cumsum(_decoded(b, s, "<u8"), dtype=np.uint64) for b, s in zip(asked.column("key").to_pylist(), sizes)]
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        cuts = np.cumsum([0, *sizes])
        out = {c: asked.column(c) for c in ("home", "group", "size")}
        for c in ("n", "m"):
            total = np.zeros(len(key), np.int64)
            for b, s, start in zip(asked.column(c).to_pylist(), sizes, cuts.tolist()):
                total[at[start : start + s]] += _decoded(b, s, "<u4")  # a home names an entry once
            out[c] = pa.array([_coded(total[at[s:e]]) for s, e in zip(cuts, cuts[1:])], pa.binary())
        return pa.table(out)

    def judge(texts: pa.Table, answers: pa.Table) -> pa.Table:
        freed()
        e = entries(texts)
        answers = answers.sort_by("group")
        n_tokens = np.bincount(e.text, minlength=texts.num_rows)
        losses = []
        for c, total in (("n", all_n), ("m", all_m)):
            decoded = [_decoded(b, s, "<i8") for b, s in zip(answers.column(c).to_pylist(), answers.column("size").to_pylist())]
            together, seen, alone = e.split(np.concatenate(decoded) if decoded else np.zeros(0, np.int64))
            # A history that the model has never seen says nothing, so that the word alone counts.
            by_word, of_history = (alone + 1) / (total + size + 1), np.where(seen > 0, weight, 0.0)
            p = of_history * together / np.maximum(seen, 1) + (1 - of_history) * by_word
            losses.append(np.bincount(e.text, -np.log(p)[e.pair], texts.num_rows) / np.maximum(n_tokens, 1))
        mine = texts.column("others").is_valid()
        columns = [pa.array(n_tokens, pa.int64()), *(pa.array(x, pa.float64(), mask=n_tokens == 0) for x in (*losses, losses[1] - losses[0]))]
        return pa.table({"others": texts.column("others")} | dict(zip(names, columns))).filter(mine)

    schema = StructType([StructField("others", kind)])
    for name in names:
        schema = schema.add(name, "long" if name == "n_tokens" else "double")
    texts = spread(rows, groups, "home", 4).groupBy("home")
    answers = spread(spread(rows, groups, "home", 4).groupBy("home").applyInArrow(ask, _ASK), groups, "group", 4).groupBy("group").applyInArrow(answer, _ANSWER)
    return texts.cogroup(spread(answers, groups, "home", 4).groupBy("home")).applyInArrow(judge, schema).select("others.*", *names)
