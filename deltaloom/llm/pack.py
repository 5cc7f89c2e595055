"""Packing tokenised documents into sequences by the sum-of-squares rule.

Documents become token ids, an end token is added, and what is longer than a
sequence is cut into pieces. A piece goes where, afterwards, the sum over all
gaps of the squared number of open sequences with that gap is smallest, be it
an open sequence or a new one.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import filterfalse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed, lean, slices, spread

#: Words, or parts of words, kept in a Python worker (some 50 MB when full); emptied when full. Longer ones are not kept.
MEMO_SIZE, MEMO_LENGTH = 200_000, 64
#: Bytes of text tokenised together.
TOGETHER = 2 << 20
#: The pattern of pre-tokenizers for which ``cut`` is written (a fixed value).
WORDS_AND_SIGNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, NUMBER, SIGN, ODD = range(5)
_memos: dict[str, "_Memo"] = {}


def _latin():
    """Kind and lower case of each Latin-1 character; control characters and unusual spaces are ODD."""
    import unicodedata

    import numpy as np

    kind, lower = np.full(256, ODD, np.uint8), np.arange(256, dtype=np.uint8)
    for i in range(256):
        category = unicodedata.category(chr(i))[0]
        if 9 <= i <= 13 or i == 32:
            kind[i] = SPACE
        elif category in "LNPS" or chr(i) == "\u00ad":
            kind[i] = {"L": LETTER, "N": NUMBER}.get(category, SIGN)
            if category == "L" and ord(chr(i).lower()) < 256:
                lower[i] = ord(chr(i).lower())
    return kind, lower


def cut(texts: list[bytes], kind, lower):
    """Lower-cased matches of WORDS_AND_SIGNS in Latin-1 texts, all of them in turn, and how many each text has."""
    import numpy as np

    raw = np.frombuffer(b"\n".join(texts) + b"\n\n\n", np.uint8)
    kinds, low = kind[raw], lower[raw]
    before = np.concatenate([[SPACE], kinds[:-1]])
    start = (kinds != SPACE) & ((kinds != before) | (kinds == NUMBER))
    # A contraction begins at an apostrophe that no run of signs has taken.
    at = np.flatnonzero((raw == 39) & (before != SIGN))
    one, two = low[at + 1], low[np.minimum(at + 2, len(low) - 1)]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
    for which, size in ((short, 2), (long & ~short, 3)):
        start[at[which] + 1] = False
        after = at[which] + size
        start[after[kinds[after] == LETTER]] = True
    where = np.flatnonzero(start)
    solid = kinds != SPACE
    offsets = np.append(np.cumsum(solid)[where] - 1, solid.sum()).astype(np.int32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    parts = pa.Array.from_buffers(pa.binary(), len(where), [None, pa.py_buffer(offsets), pa.py_buffer(low[solid])])
    return parts, np.diff(np.searchsorted(where, ends), prepend=0)


class _Memo(dict):
    """Ids (little-endian unsigned 32-bit) by word, or by part of a word.

    The tokenizer never joins tokens over white space, so a text's ids are
    those of its words in turn, and a word met before need not be encoded
    again. New words are encoded many at a time, with a mark between them that
    is one token of its own. Where the tokenizer's file says that it
    lower-cases, keeps the matches of WORDS_AND_SIGNS and marks their ends,
    texts of visible Latin-1 characters and white space, which Unicode
    normalisation leaves alone, are cut first: such parts recur more often than
    words.
    """

    MARK = "\x01"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        mark, some = self.encoded(self.MARK), "wordé-1,"
        self.mark = int.from_bytes(mark, "little") if len(mark) == 4 and self.encoded(f"{some} {self.MARK} {some}") == self.encoded(some) + mark + self.encoded(some) else None
        told = [json.loads(x.__getstate__()) if x else {} for x in (self.tokenizer.pre_tokenizer, self.tokenizer.normalizer)]
        step = (told[0].get("pretokenizers") or [{}])[0]
        lowers = [n["type"] for n in told[1].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.cuts = bool(suffix and lowers and step.get("type") == "Split" and step.get("invert") and step.get("behavior") == "Removed" and step["pattern"].get("Regex") == WORDS_AND_SIGNS)
        if self.cuts:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
            self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
            self.kind, self.lower = _latin()
            self.visible = bytes(i for i in range(256) if self.kind[i] != ODD)

    def encoded(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def encoded_words(self, words: list[str], are_cut: bool) -> Iterator[bytes]:
        """are_cut: each is one match of the pattern, so with spaces between them each has one token that ends it."""
        import numpy as np

        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            raw = self.encoded((" " if are_cut else f" {self.MARK} ").join(some))
            ids = np.frombuffer(raw, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1 if are_cut else np.append(np.flatnonzero(ids == self.mark), len(ids))
            if (self.mark is None and not are_cut) or len(stops) != len(some):  # one of them holds the mark
                yield from map(self.encoded, some)
            else:
                starts = [0, *(4 * stops[:-1] + (0 if are_cut else 4)).tolist()]
                yield from (raw[s:e] for s, e in zip(starts, (4 * stops).tolist()))

    def latin(self, text: str) -> bytes | None:
        """The text in Latin-1 if it can be cut, else None."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if not self.cuts or raw.translate(None, self.visible) or any(s in raw for s in self.special) else raw

    def ids(self, texts: list[str]) -> list[bytes]:
        plain = [self.latin(t) for t in texts]
        if some := [p for p in plain if p is not None]:
            first = iter(self.joined(*cut(some, self.kind, self.lower), are_cut=True))
        if len(some) < len(texts):
            words = [t.encode().split() for t, p in zip(texts, plain) if p is None]
            other = iter(self.joined(pa.array([w for ws in words for w in ws], pa.binary()), [len(ws) for ws in words], are_cut=False))
        return [next(other) if p is None else next(first) for p in plain]

    def joined(self, words: pa.Array, counts, are_cut: bool) -> list[bytes]:
        """The ids of each text, ``counts`` of the words."""
        import numpy as np

        coded = words.dictionary_encode()
        distinct, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self) > MEMO_SIZE:
            self.clear()
        key = distinct if are_cut else [(w,) for w in distinct]  # a part is in Latin-1, a word in UTF-8
        new = list(filterfalse(self.__contains__, key))
        self.update(zip(new, self.encoded_words([k.decode("latin-1") if are_cut else k[0].decode() for k in new], are_cut)))
        of_word = list(map(self.__getitem__, key))
        for k in new:
            if len(k if are_cut else k[0]) > MEMO_LENGTH:
                del self[k]
        size = np.fromiter(map(len, of_word), np.int64, len(of_word)) // 4
        ids, start = np.frombuffer(b"".join(of_word), "<u4"), np.cumsum(size) - size
        size = size[which]
        end = np.concatenate([[0], np.cumsum(size)])
        raw = ids[np.repeat(start[which] - end[:-1], size) + np.arange(end[-1])].tobytes()
        cuts = (4 * end[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]).tolist()
        return [raw[s:e] for s, e in zip(cuts, cuts[1:])]


def token_pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, row: Column | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every row of ``docs``; with ``row``, its value in a column of that name too.

    A document is the ids of its text (null: none) and ``end_id``; only one
    longer than ``capacity`` is cut, into pieces of ``capacity`` ids and a last
    one that may be shorter. ids is binary, little-endian unsigned 32-bit.
    ``tokenizer`` is the path of a tokenizer file, the same on all executors,
    whose pre-tokenizer never joins over white space.
    """
    end = int(end_id).to_bytes(4, "little")

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # An emptied memo is false as well, and still holds its tokenizer.
        memo = _memos[tokenizer] = _memos[tokenizer] if tokenizer in _memos else _Memo(tokenizer)
        for batch in batches:
            for some in slices(batch, "text", TOGETHER):
                yield out(some, memo.ids([t or "" for t in some.column("text").to_pylist()]))

    def out(batch: pa.RecordBatch, wholes: list[bytes]) -> pa.RecordBatch:
        rows, piece, ids = [], [], []
        for i, whole in enumerate(wholes):
            whole = whole + end
            for n, at in enumerate(range(0, len(whole), 4 * capacity)):
                rows.append(i)
                piece.append(n)
                ids.append(whole[at : at + 4 * capacity])
        taken = [batch.column(c).take(pa.array(rows, pa.int64())) for c in keys]
        return pa.RecordBatch.from_arrays([*taken, pa.array(piece, pa.int32()), pa.array([n * capacity for n in piece], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[*keys, "piece", "start", "length", "ids"])

    keys = [c for c in ("doc_id", "row") if row is not None or c != "row"]
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *([row.alias("row")] if "row" in keys else []))
    return read.mapInArrow(cut, read.drop("text").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids", "binary"))


def sum_of_squares(lengths, capacity: int):
    """For each length, in the order given, its sequence (from 0) and offset.

    Of placements with equal sums the tightest existing gap is taken, and a new
    sequence last. Full sequences are closed and no longer counted.
    """
    import numpy as np

    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, made = [], [], 0
    gain = np.empty(capacity + 1, np.int64)
    none = np.iinfo(np.int64).max
    for size in lengths:
        # Change of the sum if a sequence of gap g = size..capacity - 1 takes it.
        change = gain[: capacity - size]
        if len(change):
            have = count[size:capacity]
            np.subtract(count[: capacity - size], have, out=change)
            change *= 2
            change += 2
            change[0] = 1 - 2 * have[0]  # it is then full
            change[have == 0] = none
            best = int(change.argmin())
            into = best + size if change[best] <= (2 * count[capacity - size] + 1 if size < capacity else 0) else capacity
        else:
            into = capacity
        if into == capacity:
            which, made = made, made + 1
        else:
            which = open_by_gap[into].pop()
            count[into] -= 1
        sequence.append(which)
        offset.append(capacity - into)
        if into > size:
            open_by_gap[into - size].append(which)
            count[into - size] += 1
    return sequence, offset


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, group_rows: int = 8192, group_bytes: int = 16 << 20) -> DataFrame:
    """``token_pieces`` with sequence_id and offset: each piece's place in a sequence of at most ``capacity`` ids.

    Places of one sequence follow each other without a gap. Pieces are dealt by
    hash into groups packed one by one, of about group_rows documents and
    group_bytes of text; a group ends with few part-filled sequences, so larger
    groups waste a little less. The groups' number comes from the row count and
    bytes of the input, and a piece's group from its row's place in the input,
    not from a key, so no source, document or number of copies of it makes a
    group large. In a group pieces are placed from long to short. sequence_id
    is unique over all groups. Repeated rows are packed once each, empty tables
    give no rows, null ids stay null.
    """
    total = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.col(text))).alias("bytes")).first()
    groups = max(1, -(-total.rows // group_rows), -(-(total.bytes or 0) // group_bytes))
    pieces = token_pieces(docs, tokenizer, doc_id, text, capacity, end_id, F.monotonically_increasing_id())
    dealt = spread(pieces.withColumn("group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).cast("int")).drop("row"), groups)

    def fill(rows: pa.Table) -> pa.Table:
        import numpy as np

        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sequence, offset = sum_of_squares(rows.column("length").to_numpy().tolist(), capacity)
        first = rows.column("group")[0].as_py() << 32
        freed()
        return rows.drop_columns(["group"]).append_column("sequence_id", pa.array(np.asarray(sequence, np.int64) + first)).append_column("offset", pa.array(offset, pa.int64()))

    kind = docs.schema[doc_id].dataType.simpleString()
    return dealt.groupBy("group").applyInArrow(fill, f"doc_id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long")
