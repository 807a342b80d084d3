"""Line dedup by winnowing over line hashes.

A text's lines are split at line feeds and compared without the white space at their ends. Lines in turn that stand
earlier in the corpus too, by (id, line), are a repeated run and go if they are `RUN` lines or more, not all blank, or
have `LONG` bytes or more together; the earliest run stays.

1. Winnowing. A window is `RUN` lines in turn, or fewer with `LONG` bytes together. Each selects its line of least hash, the
   leftmost of equal ones, as its fingerprint: windows that repeat select the same fingerprint at the same place, so a
   repeated run is never missed.
2. Positions are joined by fingerprint: those whose line stands at one place only have no match and end here.
3. Extension. From each other fingerprint the lines to its left and right are compared, in the windows that selected
   it: of equal windows the first in corpus order stays and the others match it. Every window of a run is compared, so
   the union of matched windows is the run extended both ways as far as any earlier place goes.

Windows are compared by 128-bit hashes of their lines: at 10^13 windows the chance that any two different ones agree
is below 10^-12. All joins are with partial aggregates (the count or the first place of a key), so a line that a third
of the corpus shares is combined before it is dealt.

Defined results: blank lines count as lines, but a window of blank lines only is no match; a null text stays null;
ids may be of any type that has an order; other columns may have any names; rows with the same id are told apart by their text, and rows equal in both
are one place in the corpus order, so they stay or lose lines alike; a null id comes last; other columns are not
touched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.llm.common import discard, own_names, utf8, written

#: Lines of the shortest run that counts as repeated, and bytes from which fewer lines count too.
RUN, LONG = 3, 50
BLANKS = b" \t\n\x0b\f\r"
_PLACE = "named_struct('last', doc IS NULL, 'doc', doc, 'tag', tag, 'at', at)"


def winnow(hashes: np.ndarray, run: int) -> np.ndarray:
    """The fingerprint's position of each window of `run` lines: its least hash, the leftmost of equal ones."""
    windows = np.lib.stride_tricks.sliding_window_view(hashes, run)
    return windows.argmin(1) + np.arange(len(windows))


def _fold(parts: list[np.ndarray], start: int) -> np.ndarray:
    out = np.full(len(parts[0]), start, np.uint64)
    for part in parts:
        out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines of each text, 128-bit hashes of all lines as pairs of numbers, their bytes); ends are stripped."""
    raw, offsets = utf8(column)
    body, own, counts = raw.tobytes(), [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        lines = body[a:b].split(b"\n")
        counts.append(len(lines))
        own += [line.strip(BLANKS) for line in lines]
    digest = xxhash.xxh3_128_digest
    hashes = np.frombuffer(b"".join([digest(line) for line in own]), np.uint64).reshape(-1, 2)
    return np.array(counts, np.int64), hashes, np.array([len(line) for line in own], np.int64)


def windows(counts: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, run: int) -> tuple[np.ndarray, ...]:
    """(first line, lines, fingerprint, hash, second hash) of the windows of texts with `counts` lines."""
    owner = np.repeat(np.arange(len(counts)), counts)
    before = np.append(0, np.cumsum(sizes))
    found = []
    for k in range(1, run + 1):
        n = len(owner) - k + 1
        if n < 1:
            break
        bytes_ = before[k:] - before[:n]
        at = np.flatnonzero((owner[k - 1 :] == owner[:n]) & (bytes_ >= (1 if k == run else LONG)))
        keys = [_fold([np.full(len(at), k, np.uint64), *(hashes[at + j, c] for j in range(k))], 0x165667B19E3779F9) for c in (0, 1)]
        found.append((at, np.full(len(at), k), winnow(hashes[:, 0], k)[at], *keys))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(5))


def _fingerprints(run: int):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, sizes = _lines(batch.column(2))
            first, length, chosen, a, b = windows(counts, hashes, sizes, run)
            order = np.lexsort((length, first, chosen))
            first, length, chosen, a, b = (x[order] for x in (first, length, chosen, a, b))
            new = np.flatnonzero(np.diff(chosen, prepend=-1))
            owner = np.repeat(np.arange(len(counts)), counts)[chosen[new]]
            at = first - (np.cumsum(counts) - counts)[np.repeat(owner, np.diff(np.append(new, len(chosen))))]
            structs = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["at", "size", "a", "b"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(chosen)).astype(np.int32)), structs)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(owner)) for c in (0, 1)), pa.array(hashes[chosen[new], 0].view(np.int64)), lists], ["doc", "tag", "line", "windows"])

    return parse


def repeats(df: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, tag, matches array<struct<at, size>>): the windows of each text that also start earlier in the corpus."""
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    found = written(texts.mapInArrow(_fingerprints(run), f"doc {kind}, tag long, line long, windows array<struct<at:int,size:int,a:long,b:long>>"), "fingerprints")
    # Written, so that both joins have plain tables on both sides and a hot key can be split.
    several = written(found.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("line"), "several")
    single = written(found.join(several, "line").select("doc", "tag", F.inline("windows")), "windows")
    discard(found, several)
    firsts = written(single.groupBy("a", "b").agg(F.min(F.expr(_PLACE)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b", "first"), "firsts")
    matches = single.join(firsts, ["a", "b"]).where(F.expr(f"{_PLACE} > first"))
    # Written, so that the tables before it are gone when the texts are dealt.
    out = written(matches.groupBy("doc", "tag").agg(F.collect_list(F.struct("at", "size")).alias("matches")), "matches")
    discard(single, firsts)
    return out


@own_names(counts=True)
def dedup(df: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` without the lines of repeated runs; `n_chars`, if it is there, counts the kept characters. All rows stay."""
    return _cut(df, run, id_col, text_col).drop("__n_lines", "__n_removed")


def digests(df: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_removed, kept_md5) for each row; a null text has one empty line, as an empty one has."""
    out = _cut(df.select(id_col, text_col), run, id_col, text_col)
    return out.select(id_col, F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.md5(F.coalesce(text_col, F.lit(""))).alias("kept_md5"))


def _cut(df: DataFrame, run: int, id_col: str, text_col: str) -> DataFrame:
    found = repeats(df, run, id_col, text_col).select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), F.col("matches").alias("__matches"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone = [], [], []
            for text, matches in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
                text, matches = text.as_py(), matches.as_py()
                lines = (text or "").split("\n")
                drop = {m["at"] + k for m in matches or () for k in range(m["size"])}
                if drop:
                    text = "\n".join(line for i, line in enumerate(lines) if i not in drop)
                gone.append(len(drop))
                texts.append(text)
                counts.append(len(lines))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], [*batch.schema.names[:-2], "__kept", "__n_lines", "__n_removed"])

    both = df.join(found, F.col(id_col).eqNullSafe(F.col("__doc")) & (F.xxhash64(text_col) == F.col("__tag")), "left")
    others = [f for f in df.schema if f.name != text_col]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in others]
    out = both.select(*[f.name for f in others], text_col, "__matches").mapInArrow(cut, ", ".join([*fields, "__kept string, __n_lines long, __n_removed long"])).withColumnRenamed("__kept", text_col)
    return out.select(*df.columns, "__n_lines", "__n_removed")


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, line, i - 1 AS pos, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
windows AS (
  SELECT doc_id, pos, 1 AS size, [bare] AS lines FROM lines WHERE strlen(bare) >= 50
  UNION ALL
  SELECT doc_id, pos, 2, [bare, next] FROM (SELECT *, lead(bare) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM lines)
  WHERE strlen(bare) + strlen(next) >= 50
  UNION ALL
  SELECT doc_id, pos, 3, [bare, next, third]
  FROM (SELECT *, lead(bare) OVER w AS next, lead(bare, 2) OVER w AS third FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
  WHERE strlen(bare) + strlen(next) + strlen(third) > 0),
placed AS (SELECT doc_id, pos, size, row_number() OVER (PARTITION BY lines ORDER BY doc_id, pos) AS place FROM windows),
gone AS (SELECT DISTINCT doc_id, pos + unnest(range(size)) AS pos FROM placed WHERE place > 1)
SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
       md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_md5
FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
GROUP BY l.doc_id
"""
