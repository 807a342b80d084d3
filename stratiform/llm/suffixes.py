"""Suffix-array deduplication over a prefix-free parse: bytes in strings that start in an earlier document go.

Each text is parsed into phrases (`parsing`): every `SPAN`-byte window lies in one phrase, and equal windows lie in
phrases with the same trigger string. The distinct phrases are the dictionary, the phrases of each document the parse.

1. Parse. A phrase that also occurs in a document with a smaller id loses all its bytes. Phrases are dealt by
   trigger. Of a window that two phrases share, the half before the trigger or the half after it reaches `REACH` bytes
   beyond it, so a phrase that has neither of these stretches in common with another one can match nothing more.
2. Dictionary. Phrases that do share a stretch send their bytes to the trigger's bucket. There the windows are
   the dictionary's suffixes, cut at `SPAN` bytes because only equality to that length counts. Sorted bytewise, with
   the documents of the parse as the second key, they are the bucket's share of the corpus order; neighbours that
   share `SPAN` bytes are the repeats, and all but those of the smallest document lose their bytes.
3. The spans of both steps are joined to the texts.

A phrase goes out once from each group of texts that a task parses, so copies and common passages are combined
before they are dealt. A trigger with over `HOT_PHRASES` phrases in such a group is hot: its phrases are dealt by
their content, a mark for the trigger is dealt as ever, and step 2 deals its windows one by one.

Defined results: a null text is the empty text; rows with the same id are one document, among which nothing matches;
ids are integers (other types raise a TypeError); a null id is greater than all others, but one document with 2^63 - 1; texts shorter than `SPAN` stay; a character that loses some of its bytes is
dropped from the kept text; other columns are not touched; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from stratiform.llm.common import grouped, own_names, planes, starts_of, unplanes, utf8, written
from stratiform.llm.parsing import GRAM, gram_hash, mix, phrases, string_hash, words_at

SPAN = 50
#: Bytes beside a trigger that each window has on one side of it at least.
REACH = (SPAN - GRAM) // 2
#: Bytes of text that are parsed together.
GROUP_BYTES = 8 << 20
#: Distinct phrases of a trigger in one group beyond which it is hot.
HOT_PHRASES = 256
#: A bucket for each so many bytes of corpus, and as many buckets at least.
BUCKET_BYTES, MIN_BUCKETS, MAX_BUCKETS = 32 << 20, 512, 1 << 16
_LAST_ID = (1 << 63) - 1
_REMOVE, _SHARED, _HOT = 0, 1, 2
_LOW = np.uint64((1 << 48) - 1)


def _runs(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the spans [lo, hi) of each owner, which come sorted by (owner, lo)."""
    if not len(lo):
        return owner, lo, hi
    # Ends so far within an owner, by lifting each owner above the ones before it.
    lift = owner.astype(np.int64) << 33
    top = np.maximum.accumulate(hi + lift)
    new = np.ones(len(lo), bool)
    new[1:] = (lo + lift)[1:] > top[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(lo)) - 1
    return owner[first], lo[first], top[last] - lift[last]


def _span_rows(doc: np.ndarray, tag: np.ndarray, lo: np.ndarray, hi: np.ndarray, kind, key) -> pa.RecordBatch:
    n = len(doc)
    full = lambda x, t: np.broadcast_to(np.asarray(x), n).astype(t)
    return pa.RecordBatch.from_arrays(
        [pa.array(full(doc, np.int64)), pa.array(full(tag, np.int64)), pa.array(full(lo, np.int32)), pa.array(full(hi, np.int32)), pa.array(full(kind, np.int32)), pa.array(full(key, np.uint64).view(np.int64))],
        ["doc", "tag", "lo", "hi", "kind", "key"],
    )


_SPANS = "doc long, tag long, lo int, hi int, kind int, key long"
_BLOBS = "bucket int, payload binary"


def _blobs(bucket: np.ndarray, columns: list[tuple[np.ndarray, int]], kind: int, extra: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows with their bucket; a payload holds its rows column by column, and `extra` bytes (data, sizes by row)."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(starts_of(bucket))
    last = np.append(first[1:], len(bucket))
    columns = [(c[order], w) for c, w in columns]
    if extra:
        data, at = extra
        sizes = np.diff(at)[order]
        raw = data[np.repeat(at[:-1][order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        place = np.append(0, np.cumsum(sizes))
    payloads = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        parts = [bytes([kind]), (b - a).to_bytes(4, "little"), *(planes(c[a:b], w) for c, w in columns)]
        if extra:
            parts.append(raw[place[a] : place[b]].tobytes())
        payloads.append(b"".join(parts))
    for i in range(0, len(payloads), 512):
        yield pa.RecordBatch.from_arrays([pa.array(bucket[first[i : i + 512]].astype(np.int32)), pa.array(payloads[i : i + 512], pa.binary())], ["bucket", "payload"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, memoryview, int]]]:
    """(kind, payload, rows) of each bucket; the batches come sorted by bucket."""
    held, at = [], None
    for batch in batches:
        for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket != at and held:
                yield held
                held = []
            raw = memoryview(payload.as_buffer())
            held.append((raw[0], raw[5:], int.from_bytes(raw[1:5], "little")))
            at = bucket
    if held:
        yield held


def _columns(held: list[tuple[int, memoryview, int]], kind: int, widths: tuple[int, ...]) -> tuple[list[np.ndarray], list[memoryview]]:
    got, rest = [[np.zeros(0, np.uint64)] for _ in widths], []
    for own, raw, n in held:
        if own == kind:
            at = 0
            for k, width in enumerate(widths):
                got[k].append(unplanes(raw[at:], n, width))
                at += n * width
            rest.append(raw[at:])
    return [np.concatenate(g) for g in got], rest


# ---------------------------------------------------------------- step 1: the parse

_PHRASE = (6, 6, 8, 4, 4, 1, 3, 3)  # trigger, phrase, doc, tag, lo, windows, sides
_LOCAL = (8, 4, 4, 4)  # doc, tag, lo, hi


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_LAST_ID).to_numpy(zero_copy_only=False)


def _first_here(order: np.ndarray, new: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For rows in `order`, of which `new` begin a group: whether the row's document is the group's smallest."""
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(doc[order], np.flatnonzero(new)) if len(order) else doc
    out = np.zeros(len(order), bool)
    out[order] = doc[order] == least[group]
    return out


def _sides(words: np.ndarray, lo: np.ndarray, last: np.ndarray, trigger: np.ndarray) -> list[np.ndarray]:
    """24-bit hashes of each phrase's trigger with the `REACH` bytes before it, and with those after it; 0 where no window has them."""
    out = []
    for there, before, after in ((trigger - lo >= REACH, REACH, 0), (trigger - last <= SPAN - GRAM - REACH, 0, REACH)):
        side, rows = np.zeros(len(lo), np.uint64), np.flatnonzero(there)
        for a in range(0, len(rows), 1 << 16):
            k = rows[a : a + (1 << 16)]
            side[k] = np.maximum(string_hash(words, trigger[k] - before, trigger[k] + GRAM + after, GRAM + REACH) >> np.uint64(40), np.uint64(1))
        out.append(side)
    return out


def _in_common(of: np.ndarray, side: np.ndarray) -> np.ndarray:
    """For different phrases, `of` being their triggers' numbers: whether another one of the trigger has the side too."""
    _, at, n = np.unique(of.astype(np.uint64) << np.uint64(24) | side, return_inverse=True, return_counts=True)
    return (n[at] > 1) & (side > 0)


def _parse(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, 2, GROUP_BYTES):
            ids, tags = _ids(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            raw, offsets = utf8(batch.column(2))
            data = np.concatenate([raw, np.zeros(8, np.uint8)])
            text, lo, last, trigger = phrases(data, offsets, SPAN)
            if not len(text):
                continue
            words = words_at(data)
            t, p = mix(gram_hash(words, trigger)) & _LOW, np.empty(len(text), np.uint64)
            for a in range(0, len(text), 1 << 16):
                b = slice(a, a + (1 << 16))
                p[b] = string_hash(words, lo[b], last[b] + SPAN, int((last[b] - lo[b]).max()) + SPAN) & _LOW
            doc, windows = ids[text], last - lo + 1
            order = np.lexsort((p, t))
            new_t = starts_of(t[order])
            new = new_t | starts_of(p[order])
            keep = _first_here(order, new, doc)
            gone = np.flatnonzero(~keep)
            owner, a, b = _runs(text[gone], lo[gone], last[gone] + SPAN)
            base = offsets[owner]
            if len(owner):
                yield from _blobs(owner % buckets, [(ids[owner], 8), (tags[owner], 4), (a - base, 4), (b - base, 4)], 1)
            several = np.bincount(np.cumsum(new_t) - 1, new)[np.cumsum(new_t) - 1] > HOT_PHRASES
            hot = np.zeros(len(text), bool)
            hot[order] = several
            marked = np.unique(t[hot])
            columns = [t, p, doc, tags[text], lo - offsets[text], windows, *_sides(words, lo, last, trigger)]
            plain, special = np.flatnonzero(keep & ~hot), np.flatnonzero(keep & hot)
            yield from _blobs((t[plain] % np.uint64(buckets)).astype(np.int64), [(c[plain], w) for c, w in zip(columns, _PHRASE, strict=True)], 0)
            if len(special):
                yield from _blobs((p[special] % np.uint64(buckets)).astype(np.int64), [(c[special], w) for c, w in zip(columns, _PHRASE, strict=True)], 2)
                yield from _blobs((marked % np.uint64(buckets)).astype(np.int64), [(marked, 6)], 3)

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in _buckets(batches):
        (doc, tag, lo, hi), _ = _columns(held, 1, _LOCAL)
        if len(doc):
            yield _span_rows(doc.view(np.int64), tag, lo, hi, _REMOVE, 0)
        marked = np.unique(_columns(held, 3, (6,))[0][0])
        for kind in (0, 2):
            (t, p, doc, tag, lo, windows, before, after), _ = _columns(held, kind, _PHRASE)
            if not len(t):
                continue
            doc = doc.view(np.int64)
            order = np.lexsort((p, t))
            t, p, doc, tag, lo, windows, before, after = (c[order] for c in (t, p, doc, tag, lo, windows, before, after))
            new_t = starts_of(t)
            new = new_t | starts_of(p)
            first = _first_here(np.arange(len(t)), new, doc)
            of = np.cumsum(new_t) - 1
            hot = np.full(len(t), kind == 2) | np.isin(t, marked)
            shared = (_in_common(of[new], before[new]) | _in_common(of[new], after[new]))[np.cumsum(new) - 1] | hot
            out = ~first | shared
            state = np.where(~first, _REMOVE, np.where(hot, _HOT, _SHARED))
            hi = lo + windows + np.uint64(SPAN - 1)
            yield _span_rows(doc[out], tag[out], lo[out], hi[out], state[out], t[out])


# ---------------------------------------------------------------- step 2: the dictionary

_ENTRY = (8, 4, 4, 1)  # doc, tag, lo, windows


def _entries(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, 2, GROUP_BYTES):
            ids, tags = _ids(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            raw, offsets = utf8(batch.column(2))
            data = np.concatenate([raw, np.zeros(8, np.uint8)])
            spots = batch.column(3)
            text = np.repeat(np.arange(len(spots)), np.diff(spots.offsets.to_numpy()))
            flat = spots.flatten()
            lo, hi, kind, key = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            lo, hi, key = lo.astype(np.int64), hi.astype(np.int64), key.view(np.uint64)
            # The windows of hot phrases go one by one.
            times = np.where(kind == _HOT, hi - lo - SPAN + 1, 1)
            row = np.repeat(np.arange(len(lo)), times)
            shift = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            single = kind[row] == _HOT
            lo, hi = lo[row] + shift, np.where(single, lo[row] + shift + SPAN, hi[row])
            text, key = text[row], key[row]
            words = words_at(data)
            at = lo + offsets[text]
            content = string_hash(words, at, at + hi - lo, int((hi - lo).max(initial=SPAN)))
            doc = ids[text]
            order = np.argsort(content, kind="stable")
            keep = _first_here(order, starts_of(content[order]), doc)
            gone = np.flatnonzero(~keep)
            if len(gone):
                gone = gone[np.lexsort((lo[gone], text[gone]))]
                owner, a, b = _runs(text[gone], lo[gone], hi[gone])
                yield from _blobs(owner % buckets, [(ids[owner], 8), (tags[owner], 4), (a, 4), (b, 4)], 1)
            k = np.flatnonzero(keep)
            sizes = hi[k] - lo[k]
            place = np.append(0, np.cumsum(sizes))
            body = data[np.repeat(at[k] - place[:-1], sizes) + np.arange(int(place[-1]))]
            bucket = (np.where(single[k], content[k], key[k]) % np.uint64(buckets)).astype(np.int64)
            yield from _blobs(bucket, [(doc[k], 8), (tags[text[k]], 4), (lo[k], 4), (sizes - SPAN + 1, 1)], 0, (body, place))

    return run


def suffix_order(words: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the suffixes at `at` in bytewise order of their first SPAN bytes, then by document, and whether
    each differs from the one before it within those bytes."""
    steps = [*range(0, SPAN - 7, 8), *([SPAN - 8] if SPAN % 8 else [])]
    keys = [words[at + s].byteswap() for s in steps]
    order = np.lexsort((doc, *reversed(keys)))
    return order, starts_of(*(k[order] for k in keys))


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in _buckets(batches):
        (doc, tag, lo, hi), _ = _columns(held, 1, _LOCAL)
        if len(doc):
            yield _span_rows(doc.view(np.int64), tag, lo, hi, _REMOVE, 0)
        (doc, tag, lo, windows), bodies = _columns(held, 0, _ENTRY)
        if len(doc) < 2:
            continue
        doc, windows = doc.view(np.int64), windows.astype(np.int64)
        data = np.frombuffer(b"".join([*bodies, bytes(8)]), np.uint8)
        sizes = windows + SPAN - 1
        row = np.repeat(np.arange(len(doc)), windows)
        shift = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        order, new = suffix_order(words_at(data), (np.cumsum(sizes) - sizes)[row] + shift, doc[row])
        # Sorted by document within equal suffixes: the first is the smallest.
        least = doc[row][order][np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = np.sort(order[doc[row][order] > least])
        if len(gone):
            begin = lo[row[gone]].astype(np.int64) + shift[gone]
            owner, a, b = _runs(row[gone], begin, begin + SPAN)
            yield _span_rows(doc[owner], tag[owner], a, b, _REMOVE, 0)


# ---------------------------------------------------------------- the operator


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID))


def _tag(text: Column, repeated: bool) -> Column:
    """What tells rows of one id apart: the text's crc32. 0 where each id has one row, as random bytes beside each span take room."""
    return F.crc32(text.cast("binary")) if repeated else F.lit(0).cast("long")


def _sizes(df: DataFrame, id_col: str, text_col: str) -> tuple[int, bool]:
    """Bytes of all texts, and whether an id has several rows."""
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer, for its order is the order of documents: {df.schema[id_col].dataType.simpleString()}")
    docs = df.groupBy(_doc(id_col)).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text_col)).alias("size"))
    size, most = docs.agg(F.sum("size"), F.max("rows")).first()
    return size or 0, (most or 0) > 1


def _texts(df: DataFrame, id_col: str, text_col: str, repeated: bool, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(*more, _doc(id_col).alias("doc"), _tag(text, repeated).alias("tag"), text.alias("text"))


def _dealt(blobs: DataFrame) -> DataFrame:
    return blobs.repartition("bucket").sortWithinPartitions("bucket")


def spans(df: DataFrame, size: int, repeated: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, tag, spans array<struct<lo, hi>>): what each document loses, unsorted and overlapping; `size` and `repeated` as `_sizes` gives them."""
    texts = _texts(df, id_col, text_col, repeated)
    buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, size // BUCKET_BYTES))
    parsed = written(_dealt(texts.mapInArrow(_parse(buckets), _BLOBS)).mapInArrow(_resolve, _SPANS), "parse")
    open_ = parsed.where(F.col("kind") != _REMOVE).groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "hi", "kind", "key")).alias("spots"))
    entries = texts.join(open_, ["doc", "tag"]).select("doc", "tag", "text", "spots").mapInArrow(_entries(buckets), _BLOBS)
    repeats = written(_dealt(entries).mapInArrow(_sorted, _SPANS), "repeats")
    both = parsed.where(F.col("kind") == _REMOVE).union(repeats).select("doc", "tag", "lo", "hi")
    return both.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _cut(batch: pa.RecordBatch, at: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(content, starts, ends) of each row: its UTF-8 bytes and the maximal runs that go."""
    raw, offsets = utf8(batch.column(at))
    spots = batch.column(at + 1)
    flat = spots.flatten()
    counts = np.diff(spots.offsets.to_numpy()) if len(spots) else np.zeros(0, np.int64)
    counts = np.where(spots.is_valid().to_numpy(zero_copy_only=False), counts, 0)
    owner = np.repeat(np.arange(len(spots)), counts)
    lo, hi = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
    order = np.lexsort((lo, owner))
    owner, lo, hi = _runs(owner[order], lo[order], hi[order])
    edge = np.searchsorted(owner, np.arange(len(spots) + 1))
    body = raw.tobytes()
    for i in range(len(spots)):
        yield body[offsets[i] : offsets[i + 1]], lo[edge[i] : edge[i + 1]], hi[edge[i] : edge[i + 1]]


def _kept(content: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    at, parts = 0, []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        parts.append(content[at:a])
        at = b
    return b"".join([*parts, content[at:]])


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row."""
    size, repeated = _sizes(df, id_col, text_col)
    found = spans(df, size, repeated, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(c), int((b - a).sum()), len(a), hashlib.sha256(_kept(c, a, b)).hexdigest()) for c, a, b in _cut(batch, 1)]
            if rows:
                n, removed, runs, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = _texts(df, id_col, text_col, repeated, F.col(id_col).alias("id")).join(found, ["doc", "tag"], "left").select("id", "text", "spans")
    kind = df.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


@own_names(counts=True)
def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with the kept text; `n_chars`, if it is there, counts the kept characters. All rows stay."""
    size, repeated = _sizes(df, id_col, text_col)
    found = spans(df, size, repeated, id_col, text_col).select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), F.col("spans").alias("__spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.num_columns - 2
            before = batch.column(at)
            texts = [_kept(*row).decode("utf-8", "ignore") if len(row[1]) else before[i].as_py() for i, row in enumerate(_cut(batch, at))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string())], [*batch.schema.names[:at], "__kept"])

    tag = _tag(F.coalesce(F.col(text_col), F.lit("")), repeated)
    both = df.join(found, (_doc(id_col) == F.col("__doc")) & (tag == F.col("__tag")), "left")
    others = [c for c in df.columns if c != text_col]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text_col]
    cut = both.select(*others, text_col, "__spans").mapInArrow(run, ", ".join([*fields, "__kept string"])).withColumnRenamed("__kept", text_col)
    return cut.select(df.columns)
