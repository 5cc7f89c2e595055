"""Removal of repeated byte strings by suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts earlier is
removed, in the same document or in one with a smaller id.

*Dealing.* The text cannot be sorted in one place, so windows that may be equal
are brought together: each window of ``length`` bytes is known by the
``GRAM``-byte string in it with the least hash, its anchor. Equal windows have
the same anchor. Neighbouring windows with one anchor form a passage.
Passages with equal bytes are one class, of which the first is compared with
others and the rest are repeats of it. They are known by two 64-bit hashes of
two kinds, of the anchor and of all bytes.

*Sorting.* The first passages of classes that share an anchor go to one task,
which builds their suffix array by two-stage sorting: only suffixes smaller
than their successors are sorted directly, the others are induced by scans of
the buckets. Windows whose adjacent common prefix is at least ``length`` are
equal, and all but the first of them are repeats.

*Frequent anchors.* A string that very many documents have between differing
neighbours is the anchor of a passage in each of them. The windows of such
anchors are dealt one by one by two 64-bit hashes of their bytes, each home of
documents passing on the first of equal ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import dropped, freed, lean, spread, stored

#: Bytes of an anchor; bytes of text whose passages are compared in a task before any are passed on; bytes of text hashed at once.
GRAM, CHUNK, PART = 32, 4 << 20, 1 << 18
#: Bytes of text for each group that passages, or documents, are dealt to.
GROUP_BYTES = 2 << 20
#: Bytes of passages sorted at once, but for those of one anchor.
SORT_BYTES = 1 << 20
#: An anchor of more passages than these is frequent.
FREQUENT = 1 << 14
_ODD = 0x9E3779B97F4A7C15
_LAST = 2**63 - 1


def _mix(x):
    import numpy as np

    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _powers(n: int):
    """A number for each byte, and powers of an odd number and of its inverse."""
    import numpy as np

    out = []
    for base in (_ODD, pow(_ODD, -1, 2**64)):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers))
    return np.random.default_rng(3).integers(0, 2**64, 256, np.uint64), *out


class _Hasher:
    """Hashes of all substrings of a byte array, from sums of bytes times powers of an odd number."""

    def __init__(self, raw):
        import numpy as np

        n = len(raw) + 1
        table, powers, self.back = _powers(-(-n // PART) * PART)  # a few lengths only, so they are seldom made anew
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(table[raw] * powers[: n - 1], out=self.sums[1:])

    def of(self, start, stop):
        import numpy as np

        return _mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))


def passages(raw, doc_starts, length: int):
    """Passages of texts laid end to end: first window, number of windows, anchor hash, hash of the passage's bytes.

    doc_starts: where texts start, and the end.
    """
    import numpy as np
    import xxhash

    if len(raw) < length:
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))
    hasher = _Hasher(raw)
    at = np.arange(len(raw) - GRAM + 1)
    low = np.uint64((1 << 24) - 1)  # the caller cuts longer texts
    order = (hasher.of(at, at + GRAM) & ~low) | (at.astype(np.uint64) & low)
    width, reach = length - GRAM + 1, 1
    while 2 * reach <= width:
        order = np.minimum(order[:-reach], order[reach:])
        reach *= 2
    if width > reach:
        order = np.minimum(order[: len(order) - (width - reach)], order[width - reach :])
    window = np.arange(len(order))
    inside = np.zeros(len(raw) + 1, np.int8)
    begin, end = doc_starts[:-1], np.maximum(doc_starts[1:] - length + 1, doc_starts[:-1])
    np.add.at(inside, begin, 1)
    np.add.at(inside, end, -1)
    valid = np.cumsum(inside)[: len(order)] > 0
    anchor = (order & low).astype(np.int64)
    new = np.ones(len(order), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[begin[begin < len(order)]] = True
    new[1:] |= valid[1:] & ~valid[:-1]
    number = np.cumsum(new) - 1
    first = window[new]
    count = np.bincount(number[valid], minlength=len(first))
    first, count = first[count > 0], count[count > 0]
    where = anchor[first]
    whole = raw.tobytes()
    named = (xxhash.xxh3_64_intdigest(whole[s:e]) for s, e in zip(first.tolist(), (first + count + (length - 1)).tolist()))
    return first, count, hasher.of(where, where + GRAM), np.fromiter(named, np.uint64, len(first))


def suffix_array(raw, lengths, n_windows, length: int):
    """Window starts of the passages laid end to end in ``raw``, in the order of their first ``length`` bytes.

    Two-stage sorting. A suffix is of type B if it is smaller than its
    successor, else of type A; a passage's end counts as smaller than any byte.
    Type B is sorted directly. Each suffix of type A is one byte and a suffix
    that is already in place when the buckets of first bytes are scanned in
    order, so scanning writes them to their buckets in order. Only windows and
    what induces the last of them take part.
    """
    import numpy as np

    n = len(lengths)
    # A zero after each passage; bytes are counted from 1.
    shift = np.arange(n)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) + shift
    text = np.zeros(len(raw) + n, np.uint16)
    text[np.arange(len(raw)) + np.repeat(shift, lengths)] = raw.astype(np.uint16) + 1
    last = len(text) - 1
    ends = starts + lengths
    # Type by the next place where the byte changes.
    differs = np.flatnonzero(text[:-1] != text[1:])
    after = differs[np.minimum(np.searchsorted(differs, np.arange(last)), len(differs) - 1)] if len(differs) else np.zeros(last, np.int64)
    smaller = np.zeros(last + 1, bool)
    if len(differs):
        smaller[:-1] = text[after] < text[after + 1]
    smaller[text == 0] = False
    windows = np.repeat(starts - np.concatenate([[0], np.cumsum(n_windows)[:-1]]), n_windows) + np.arange(n_windows.sum())
    taking = np.zeros(last + 1, bool)
    taking[windows] = True
    reach = starts + n_windows - 1  # from each last window on, while of type A, its successor too
    while len(reach := reach[~smaller[reach] & (text[reach] > 0)]):
        reach = reach + 1
        taking[reach] = True
    # First stage: words of eight bytes, one after another, for what is still tied.
    # Nine bits a byte would be needed for the end; order behind an end does not matter.
    word = np.zeros(last + 1 + length + 8, np.uint64)
    padded = np.zeros(len(word) + 8, np.uint64)
    padded[: last + 1] = np.maximum(text, 1) - 1
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j : j + len(word)]
    direct = np.flatnonzero(taking & smaller)
    direct = direct[np.argsort(word[direct], kind="stable")]
    tied, group = _tied(np.arange(len(direct)), np.zeros(len(direct), np.int64), word[direct])
    for j in range(1, -(-length // 8)):
        if not len(tied):
            break
        key = word[direct[tied] + 8 * j]
        by = np.lexsort((key, group))
        direct[tied], key = direct[tied][by], key[by]
        tied, group = _tied(tied, group, key)
    # Second stage: scan the buckets in the order of their byte.
    cuts = np.searchsorted(text[direct], np.arange(258))
    waiting: list[list] = [[] for _ in range(257)]
    if taking[ends].any():
        waiting[0].append(ends[taking[ends]])
    out = []

    def induce(scanned, c):
        before = scanned[scanned > 0] - 1
        before = before[taking[before] & ~smaller[before] & (text[before] > 0)]
        byte = text[before]
        by = np.argsort(byte, kind="stable")
        byte, before = byte[by], before[by]
        at = np.flatnonzero(np.diff(byte, prepend=0))
        same = before[:0]
        for s, e in zip(at, [*at[1:], len(byte)]):
            if byte[s] == c:
                same = before[s:e]
            else:
                waiting[byte[s]].append(before[s:e])
        return same

    for c in range(257):
        wave = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        while len(wave):
            out.append(wave)
            wave = induce(wave, c)
        if cuts[c] < cuts[c + 1]:
            out.append(direct[cuts[c] : cuts[c + 1]])
            induce(out[-1], c)
    order = np.concatenate(out) if out else direct
    is_window = np.zeros(last + 1, bool)
    is_window[windows] = True
    order = order[is_window[order]]
    return order, word, windows


def _tied(places, group, key):
    """Of sorted entries, those that share group and key with a neighbour, and their new group numbers."""
    import numpy as np

    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
    number = np.cumsum(new) - 1
    many = np.bincount(number, minlength=1)[number] > 1 if len(key) else new
    return places[many], number[many]


def equal_windows(raw, lengths, n_windows, length: int):
    """For each window, in the order of the passages, the number of its class of equal windows."""
    import numpy as np

    order, word, windows = suffix_array(raw, lengths, n_windows, length)
    # Common prefixes of neighbours, in words of eight bytes and a part of one.
    common = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for j in range(0, length, 8):
        x, y = word[order[alive] + j], word[order[alive - 1] + j]
        if length - j < 8:
            cut = np.uint64(8 * (8 - (length - j)))
            x, y = x >> cut, y >> cut
        alive = alive[x == y]
        common[alive] = min(j + 8, length)
    name = np.cumsum(common < length)
    out = np.empty(len(windows), np.int64)
    out[np.searchsorted(windows, order)] = name
    return out


def _pack(columns: dict, key) -> Iterator[tuple[int, dict]]:
    """Splits arrays by ``key``."""
    import numpy as np

    by = np.argsort(key, kind="stable")
    sorted_key = key[by]
    at = np.flatnonzero(np.diff(sorted_key, prepend=-1)) if len(key) else []
    for s, e in zip(at, [*at[1:], len(key)]):
        yield int(sorted_key[s]), {c: v[by[s:e]] for c, v in columns.items()}


def _blobs(rows: list[tuple[int, int, dict]], fields: tuple[str, ...]) -> pa.RecordBatch:
    """One row per (kind, group, arrays)."""
    columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())]
    columns += [pa.array([r[2][f].tobytes() if f in r[2] else None for r in rows], pa.binary()) for f in fields]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "group", *fields])


_FIELDS = ("doc", "tie", "start", "windows", "anchor", "passage", "home", "raw")
_BLOB = "kind int, group long, " + ", ".join(f"{f} binary" for f in _FIELDS)
_KINDS = {"doc": "<i8", "tie": "<u4", "start": "<u4", "windows": "<u2", "anchor": "<u8", "passage": "<u8", "home": "<u4", "raw": "u1"}


def _unpacked(table: pa.Table, *fields: str) -> dict:
    import numpy as np

    return {f: np.frombuffer(b"".join(x for x in table.column(f).to_pylist() if x), _KINDS[f]) for f in fields}


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """``docs`` without ``text``, with n_bytes, kept and spans.

    Columns of these names are replaced, all others stay. Texts are UTF-8 bytes (null: empty). kept: the bytes left, laid end to
    end; spans: the maximal removed runs as (start, length). A string is
    repeated if it starts earlier: in a smaller doc_id, or in the same
    document at a smaller start. Rows with the same doc_id count as places of
    one document: between them the smaller start is earlier, and strings at
    the same start do not remove each other. A null doc_id is greater than
    any other. Texts shorter than ``length`` are kept whole; empty tables give
    no rows. doc_id is an integer.

    Passages of one anchor are equal if 64-bit hashes of their bytes are; the
    anchor's own hash is of another kind. A passage and a document are each dealt by hash, so neither a source nor a
    passage that very many documents share fills one task: of equal passages a
    task passes on the first.
    """
    import numpy as np

    if not GRAM < length < 1 << 16:
        raise ValueError(f"length must be more than {GRAM} and less than {1 << 16}")
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    groups = max(1, -(-n_bytes // GROUP_BYTES))
    others = [c for c in docs.columns if c not in (text, "n_bytes", "kept", "spans")]
    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("raw"), F.struct(*others).alias("others"))
    source = source.withColumn("tie", F.crc32("raw")).withColumn("group", F.pmod(F.xxhash64("doc", "tie"), F.lit(groups)))

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks():
            held, size = [], 0
            for batch in batches:
                columns = [batch.column(c) for c in ("doc", "tie", "group", "raw")]
                for i in range(batch.num_rows):  # one text at a time is copied
                    row = tuple(c[i].as_py() for c in columns)
                    if len(row[3]) < length:
                        continue
                    held.append(row)
                    size += len(row[3])
                    if size >= CHUNK:
                        yield held
                        held, size = [], 0
            if held:
                yield held

        for held in chunks():
            held.sort(key=lambda r: r[:2])
            # A document is laid in parts that overlap by all but one byte of a window, so that no part is too long for the anchors' order.
            piece = PART
            doc, tie, group, offset, parts = [], [], [], [], []
            for d, t, g, r in held:
                for at in range(0, max(1, len(r) - length + 1), piece):
                    doc.append(d)
                    tie.append(t)
                    group.append(g)
                    offset.append(at)
                    parts.append(r[at : at + piece + length - 1])
            rows, at = [], 0
            doc, tie, group, offset = np.array(doc), np.array(tie, np.uint32), np.array(group), np.array(offset)
            found = []
            while at < len(parts):  # lay parts end to end
                some, size = at, 0
                while at < len(parts) and (at == some or size + len(parts[at]) < PART + piece):
                    size += len(parts[at])
                    at += 1
                starts = np.concatenate([[0], np.cumsum([len(p) for p in parts[some:at]])])
                first, count, anchor, passage = passages(np.frombuffer(b"".join(parts[some:at]), np.uint8), starts, length)
                which = np.searchsorted(starts, first, side="right") - 1
                found.append((which + some, first - starts[which] + offset[which + some], count, anchor, passage))
            which, start, count, anchor, passage = (np.concatenate(x) for x in zip(*found))
            run = {"doc": doc[which], "tie": tie[which], "start": start.astype(np.uint32), "windows": count.astype("<u2"), "anchor": anchor, "passage": passage}
            by = np.lexsort((start, run["doc"], passage, anchor))
            run = {k: v[by] for k, v in run.items()}
            home = group[which[by]]
            repeat = _repeats(run)
            for g, blob in _pack({k: run[k][repeat] for k in ("doc", "tie", "start", "windows")}, home[repeat]):
                rows.append((0, g, blob))
            one = {k: v[~_later(run)] for k, v in run.items()}
            one["home"] = home[~_later(run)].astype("<u4")
            for g, blob in _pack(one, (one["anchor"] % np.uint64(groups)).astype(np.int64)):
                rows.append((1, g, blob))
            yield _blobs(rows, _FIELDS)

    def join_passages(blobs: pa.Table) -> pa.Table:
        freed()
        run = _unpacked(blobs, *_FIELDS[:-1])
        by = np.lexsort((run["start"], run["doc"], run["passage"], run["anchor"]))
        run = {k: v[by] for k, v in run.items()}
        repeat = _repeats(run)
        rows = [(0, g, b) for g, b in _pack({k: run[k][repeat] for k in ("doc", "tie", "start", "windows")}, run["home"][repeat].astype(np.int64))]
        first = {k: v[~_later(run)] for k, v in run.items()}
        # Anchors with more than one class of passages.
        same = np.zeros(len(first["anchor"]) + 1, bool)
        same[1:-1] = first["anchor"][1:] == first["anchor"][:-1]
        several = same[1:] | same[:-1]
        first = {k: v[several] for k, v in first.items()}
        rows += [(1, g, b) for g, b in _pack({k: first[k] for k in ("doc", "tie", "start", "windows", "anchor")}, first["home"].astype(np.int64))]
        return pa.Table.from_batches([_blobs(rows, _FIELDS)])

    @lean
    def count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, blob in zip(batch.column("group").to_pylist(), batch.column("anchor").to_pylist()):
                anchor, n = np.unique(np.frombuffer(blob, "<i8"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(anchor), group)), pa.array(anchor), pa.array(n, pa.int64())], names=["group", "anchor", "n"])

    @lean
    def part_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Passages of their group's frequent anchors (``often``) go to the homes of their documents at once (kind 4), the others stay."""
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                run = _unpacked(pa.Table.from_batches([row]), *_FIELDS[:-1])
                often = np.isin(run["anchor"], np.array(row.column("often")[0].as_py(), np.int64).view(np.uint64))
                rows = [(4, g, b) for g, b in _pack({k: run[k][often] for k in ("doc", "tie", "start", "windows", "anchor")}, run["home"][often].astype(np.int64))]
                if not often.all():
                    rows.append((1, row.column("group")[0].as_py(), {k: v[~often] for k, v in run.items()}))
                yield _blobs(rows, _FIELDS)

    def fetch(texts: pa.Table, asked: pa.Table) -> pa.Table:
        freed()
        kind = asked.column("kind").to_numpy()
        run, alone = (_unpacked(asked.filter(pa.array(kind == k)), "doc", "tie", "start", "windows", "anchor") for k in (1, 4))
        if not len(run["doc"]) and not len(alone["doc"]):
            return pa.Table.from_batches([_blobs([], _FIELDS)])
        at = {(d, t): i for i, (d, t) in enumerate(zip(texts.column("doc").to_pylist(), texts.column("tie").to_pylist()))}
        rows = []
        whole = texts.column("raw").to_pylist()
        home = texts.column("group")[0].as_py()
        if len(alone["doc"]):
            rows += windows_of(alone, whole, at, home)
        by = np.lexsort((run["start"], run["tie"], run["doc"]))
        run = {k: v[by] for k, v in run.items()}
        pieces = [whole[at[d, t]][s : s + n + length - 1] for d, t, s, n in zip(*(run[k].tolist() for k in ("doc", "tie", "start", "windows")))]
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        size = run["windows"].astype(np.int64) + length - 1
        to = (run["anchor"] % np.uint64(groups)).astype(np.int64)
        for g, blob in _pack({k: run[k] for k in ("doc", "tie", "start", "windows", "anchor")} | {"size": size, "place": np.cumsum(size) - size}, to):
            size_, place = blob.pop("size"), blob.pop("place")
            take = np.repeat(place - (np.cumsum(size_) - size_), size_) + np.arange(size_.sum())
            blob["raw"] = raw[take]
            blob["home"] = np.full(len(size_), home, "<u4")  # where the answer goes
            rows.append((2, g, blob))
        return pa.Table.from_batches([_blobs(rows, _FIELDS)])

    def windows_of(run: dict, whole: list, at: dict, home: int) -> list:
        """Rows of the windows of frequent anchors: repeats within the home, and the others by the group of their hashes (the second one in the place of an anchor)."""
        import xxhash

        by = np.argsort(run["doc"], kind="stable")  # a part of the passages at a time is hashed
        out = []
        for some in np.array_split(by, max(1, len(by) >> 12)):
            part = {k: v[some] for k, v in run.items()}
            n = part["windows"].astype(np.int64)
            pieces = [whole[at[d, t]][s : s + c + length - 1] for d, t, s, c in zip(*(part[k].tolist() for k in ("doc", "tie", "start", "windows")))]
            owner = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            first = (np.cumsum(n + length - 1) - (n + length - 1))[owner] + place
            laid = b"".join(pieces)
            name = np.fromiter((xxhash.xxh3_64_intdigest(laid[s : s + length]) for s in first.tolist()), np.uint64, len(first))
            out.append({"doc": part["doc"][owner], "tie": part["tie"][owner], "start": (part["start"][owner] + place).astype("<u4"), "passage": name, "anchor": _Hasher(np.frombuffer(laid, np.uint8)).of(first, first + length)})
        out = {k: np.concatenate([x[k] for x in out]) for k in out[0]}
        out["home"] = np.full(len(out["doc"]), home, "<u4")
        repeat, out = _equal(out)
        rows = [(0, home, _single({k: v[repeat] for k, v in out.items()}))] if repeat.any() else []
        return rows + [(3, g, b) for g, b in _pack({k: v[~repeat] for k, v in out.items()}, (out["passage"][~repeat] % np.uint64(groups)).astype(np.int64))]

    def sort_suffixes(blobs: pa.Table) -> pa.Table:
        freed()
        kind = blobs.column("kind").to_numpy()
        done = blobs.filter(pa.array(kind == 0))
        repeat, one = _equal(_unpacked(blobs.filter(pa.array(kind == 3)), "doc", "tie", "start", "anchor", "passage", "home"))
        one = {k: v[repeat] for k, v in one.items()}
        rows = [(0, g, b) for g, b in _pack(_single(one), one["home"].astype(np.int64))]
        run = _unpacked(blobs.filter(pa.array(kind == 2)), "doc", "tie", "start", "windows", "anchor", "home", "raw")
        if len(run["doc"]):
            # The passages of some anchors at a time.
            raw, size = run.pop("raw"), run["windows"].astype(np.int64) + length - 1
            from_ = np.cumsum(size) - size
            by = np.argsort(run["anchor"], kind="stable")
            upto, anchor = np.cumsum(size[by]), run["anchor"][by]
            s = 0
            while s < len(by):
                e = max(s + 1, int(np.searchsorted(upto, upto[s] - size[by[s]] + SORT_BYTES, side="right")))
                e = int(np.searchsorted(anchor, anchor[e - 1], side="right"))
                some = by[s:e]
                rows += repeated({k: v[some] for k, v in run.items()}, np.concatenate([raw[a : a + n] for a, n in zip(from_[some].tolist(), size[some].tolist())]))
                s = e
        return pa.concat_tables([done, pa.Table.from_batches([_blobs(rows, _FIELDS)]).cast(done.schema)])

    def repeated(run: dict, raw) -> list:
        """Rows of the windows of the passages ``run``, laid end to end in ``raw``, that are not the first of their class."""
        n = run["windows"].astype(np.int64)
        name = equal_windows(raw, n + length - 1, n, length)
        owner = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        doc, start = run["doc"][owner], run["start"][owner].astype(np.int64) + place
        by = np.lexsort((start, doc, name))
        first = np.ones(len(by), bool)
        first[1:] = name[by][1:] != name[by][:-1]
        head = by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
        repeat = np.zeros(len(by), bool)
        repeat[by] = (doc[by] != doc[head]) | (start[by] != start[head])
        # Neighbouring repeated windows of a passage are one run.
        begin = repeat.copy()
        begin[1:] &= ~(repeat[:-1] & (owner[1:] == owner[:-1]))
        at = np.flatnonzero(begin)
        count = np.bincount(np.cumsum(begin)[repeat] - 1, minlength=len(at)) if len(at) else at
        told = {"doc": doc[at], "tie": run["tie"][owner[at]], "start": start[at].astype("<u4"), "windows": count.astype("<u2")}
        return [(0, g, b) for g, b in _pack(told, run["home"][owner[at]].astype(np.int64))]

    def remove(texts: pa.Table, repeats: pa.Table) -> pa.Table:
        freed()
        run = _unpacked(repeats, "doc", "tie", "start", "windows")
        by = np.lexsort((run["tie"], run["doc"]))
        run = {k: v[by] for k, v in run.items()}
        new = np.ones(len(by), bool)
        new[1:] = (run["doc"][1:] != run["doc"][:-1]) | (run["tie"][1:] != run["tie"][:-1])
        cuts = np.flatnonzero(new)
        mine = {(int(run["doc"][s]), int(run["tie"][s])): slice(s, e) for s, e in zip(cuts, [*cuts[1:], len(by)])}
        kept, spans = [], []
        for d, t, raw in zip(*(texts.column(c).to_pylist() for c in ("doc", "tie", "raw"))):
            if (part := mine.get((d, t))) is None:
                kept.append(raw)
                spans.append([])
                continue
            change = np.zeros(len(raw) + 1, np.int64)
            start = run["start"][part].astype(np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, start + run["windows"][part] + (length - 1), -1)
            gone = np.cumsum(change[:-1]) > 0
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
            edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
            spans.append([{"start": s, "length": e - s} for s, e in zip(edge[::2], edge[1::2])])
        return pa.table({"others": texts.column("others"), "n_bytes": pa.array([len(x) for x in texts.column("raw").to_pylist()], pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))})

    dealt = stored(source.select("doc", "tie", "group", "raw").mapInArrow(cut, _BLOB), "passages")
    # Only groups with many passages can hold a frequent anchor.
    full = stored(dealt.filter("kind = 1").groupBy("group").agg(F.sum(F.length("anchor")).alias("n")).filter(F.col("n") > 8 * FREQUENT).select("group"), "full")
    joined, often, parted = dealt.filter("kind = 1"), None, None
    if full.limit(1).count():
        counted = joined.join(full, "group").select("group", "anchor").mapInArrow(count_anchors, "group long, anchor long, n long")
        counted = counted.groupBy("group", "anchor").agg(F.sum("n").alias("n")).filter(F.col("n") > FREQUENT)
        # Some few a group: each has more than FREQUENT passages. They meet the passages by a join, which Spark broadcasts only while they are small.
        often = stored(counted.groupBy("group").agg(F.collect_list("anchor").alias("often")), "often")
        parted = stored(joined.join(often, "group").select(*dealt.columns, "often").mapInArrow(part_frequent, _BLOB), "parted")
        joined = joined.join(often, "group", "left_anti").unionByName(parted.filter("kind = 1"))
    joined = spread(joined, groups).groupBy("group").applyInArrow(join_passages, _BLOB).unionByName(dealt.filter("kind = 0"))
    if parted is not None:
        joined = joined.unionByName(parted.filter("kind = 4"))
    joined = stored(joined, "classes")
    for done in (full, often, parted, dealt):
        dropped(done)
    texts = spread(source, groups).groupBy("group")
    asked = spread(joined.filter("kind in (1, 4)"), groups).groupBy("group")
    sorted_ = spread(texts.cogroup(asked).applyInArrow(fetch, _BLOB), groups).groupBy("group").applyInArrow(sort_suffixes, _BLOB)
    repeats = joined.filter("kind = 0").unionByName(sorted_)
    span = StructType([StructField("start", LongType()), StructField("length", LongType())])
    schema = StructType([StructField("others", docs.select(*others).schema), StructField("n_bytes", LongType()), StructField("kept", BinaryType()), StructField("spans", ArrayType(span))])
    return texts.cogroup(spread(repeats, groups).groupBy("group")).applyInArrow(remove, schema).select("others.*", "n_bytes", "kept", "spans")


def _later(run: dict):
    """In order of class and place: whether a passage is not the first of its class."""
    import numpy as np

    later = np.zeros(len(run["anchor"]), bool)
    later[1:] = (run["anchor"][1:] == run["anchor"][:-1]) & (run["passage"][1:] == run["passage"][:-1])
    return later


def _repeats(run: dict):
    """Those that come later than the first of their class, not at the same start of the same id."""
    import numpy as np

    later = _later(run)
    head = np.maximum.accumulate(np.where(later, 0, np.arange(len(later)))) if len(later) else np.zeros(0, np.int64)
    return later & ((run["doc"] != run["doc"][head]) | (run["start"] != run["start"][head]))


def _equal(windows: dict):
    """Windows in the order of their hash and place, and which of them are repeats of an earlier one."""
    import numpy as np

    by = np.lexsort((windows["start"], windows["doc"], windows["anchor"], windows["passage"]))
    windows = {k: v[by] for k, v in windows.items()}
    return _repeats(windows), windows


def _single(windows: dict) -> dict:
    """Runs of one window each."""
    import numpy as np

    return {k: windows[k] for k in ("doc", "tie", "start")} | {"windows": np.ones(len(windows["doc"]), "<u2")}
