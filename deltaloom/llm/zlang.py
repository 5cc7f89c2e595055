"""Language ID by compression: the language whose text helps most to compress a document.

For each language a zstandard raw-content dictionary is made of labelled text.
A document is encoded with every dictionary; the language with the fewest bytes
is chosen, and a document whose two best languages are nearly as good as each
other is rejected. Whole bytes are a coarse measure of a few words, so narrow
margins are measured a second time, with the document's words in several orders.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, slices

#: Bytes of text in a block; every block is encoded on its own, so that the dictionary, not what the document itself has already said, explains it.
BLOCK = 2048
#: Bytes of text taken from a batch at once.
TOGETHER = 4 << 20
UNKNOWN = "und"


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 256, excerpt: int = 512, max_languages: int = 512) -> dict[str, bytes]:
    """A raw-content dictionary for each value of ``lang``, from rows with text and lang.

    The sample is bounded: per_language rows of a language, those with the
    smallest hash of ``key``, and excerpt characters of each, from a place that
    the hash chooses; max_languages languages, which bounds what is sent to the
    executors (more raise an error; set it higher, or per_language lower).
    Rows without a letter are left out. Ties between equal hashes fall to the
    smaller text hash.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    rows = rows.withColumn("deltaloom_hash", F.xxhash64(F.lit(7), F.col(key)))
    place = F.pmod(F.xxhash64("deltaloom_hash"), F.greatest(F.length(text) - excerpt + 1, F.lit(1))).cast("int") + 1
    brief = rows.select(F.col(lang).alias("lang"), F.substring(F.col(text), place, F.lit(excerpt)).alias("text"), F.col("deltaloom_hash").alias("hash"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash", F.xxhash64("text")))
    first = brief.withColumn("place", place).filter(F.col("place") <= per_language)
    if len(seen := first.filter("place = 1").limit(max_languages + 1).collect()) > max_languages:
        raise ValueError(f"more than max_languages = {max_languages} languages")
    if not seen:
        return {}
    out: dict[str, bytes] = {}
    for row in first.orderBy("lang", F.desc("place")).collect():
        out[row.lang] = out.get(row.lang, b"") + row.text.lower().encode() + b"\n"
    return out


def coders(dictionaries: dict[str, bytes], level: int, length: int) -> list:
    """A function from bytes to their frame for each dictionary, for blocks of up to ``length`` bytes."""
    import zstandard

    out = []
    for content in dictionaries.values():
        params = zstandard.ZstdCompressionParameters.from_level(level, source_size=length, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=params)
        out.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params).compress)
    return out


def frame_sizes(text: str, coders: list) -> list[int]:
    """The bytes that the lower-cased text takes with each dictionary."""
    raw = text.lower().encode()
    blocks = [raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)]
    return [sum(len(code(block)) for block in blocks) for code in coders]


def saving(sizes: list[int]) -> tuple[int, float]:
    """The place of the smallest (first of ties), and the share it saves over the next."""
    best = min(range(len(sizes)), key=sizes.__getitem__)
    return best, (min(sizes[:best] + sizes[best + 1 :]) - sizes[best]) / sizes[best] if len(sizes) > 1 else 1.0


def closer_sizes(text: str, coders: list, orders: int = 8) -> list[int]:
    """Sums of ``frame_sizes`` over rotations of the text's words: what one frame rounds to a whole byte, several tell apart."""
    words = text.split()
    turned = [" ".join(words[at:] + words[:at]) for at in range(0, len(words), -(-len(words) // orders))]
    return [sum(s) for s in zip(*(frame_sizes(t, coders) for t in turned))]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = 0.01, level: int = 7) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected.

    lang_pred is the language with the fewest bytes (ties: first by code
    point); ``und`` if text is null or has no letter or no language was learned. score: the
    share of bytes that the chosen language saves over the next, against
    ``margin``: s / (s + margin); 0 for ``und``, 1 if only one language was learned.
    Where the share is below ``margin``, language and share are those of
    ``closer_sizes``. rejected: ``und``, or the share saved is still below
    ``margin``. Columns of these names are replaced, all others stay; empty
    tables stay empty; every whole text is encoded, block by block (a character
    that two blocks share is encoded as its bytes), at one ``level``.
    """
    dictionaries = dict(sorted(dictionaries.items()))
    names = list(dictionaries)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]

    def judged(value: str, by: list) -> tuple[str, float]:
        best, saved = saving(frame_sizes(value, by))
        if saved < margin:
            best, saved = saving(closer_sizes(value, by))
        return names[best], saved / (saved + margin) if len(names) > 1 else 1.0

    @lean
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = coders(dictionaries, level, BLOCK)
        for batch in (some for batch in batches for some in slices(batch, text, TOGETHER)):
            told = [judged(t.as_py(), by) if k and names else (UNKNOWN, 0.0) for t, k in zip(batch.column(text), batch.column("deltaloom_letters").to_pylist())]
            arrays = [batch.column(c) for c in keep] + [pa.array([p for p, _ in told], pa.string()), pa.array([s for _, s in told], pa.float64()), pa.array([s < 0.5 for _, s in told], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "lang_pred", "score", "rejected"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.withColumn("deltaloom_letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).mapInArrow(judge, schema)
