"""GeoJSON files of any size read by byte ranges: many tasks a file, the same rows as ``geojson.scan``.

Spark's text reader splits a file at closing braces, and each task joins its pieces to blocks. Whether a block starts inside a
string, and how deep, depends on all text before it, so a block tells what it does to each of the three states it may start in
(outside a string, inside, behind a backslash). One fold over these few numbers a block gives every block its true state, and
blocks then find the objects of the arrays in the root. Objects that pass a block's end are put together from their fragments.
Text outside these objects is parsed for itself, with one mark for each run of objects, so a file is refused exactly where a
strict parse of the whole would refuse it. Files must not be compressed.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.operators import shared
from trellis.sources import geojson

#: Characters of a block, and of all text outside of features that a file may have.
BLOCK, OUTSIDE = 4 << 20, 64 << 20
_REST = r'[^"\\]*(?:\\.[^"\\]*)*'
_STRING, _CLOSE, _OPEN_END = re.compile(f'"{_REST}"', re.S), re.compile(f'{_REST}"', re.S), re.compile(rf'"{_REST}(\\?)\Z', re.S)
_MARK = "\x02"
_RUN = re.compile(f"{_MARK}(?:[ \t\n\r]*,[ \t\n\r]*{_MARK})+")
_BLOCKS = "district string, file_size bigint, split bigint, seq int, bytes bigint, text string, effect string"
_STATE = "district string, split bigint, seq int, block int, inside int, depth int, in_array boolean, arrays int, opened int, cut boolean, sound boolean"
_FOUND = "district string, block int, i int, arrays int, opened int, part string, text string"


def blanked(text: str, inside: int) -> tuple[str, int]:
    """The text with its strings blanked, from a state (0 outside a string, 1 inside, 2 behind a backslash), and its last state."""
    skip = 0
    if inside:
        skip = min(inside - 1, len(text))
        if inside == 2 and not text:
            return text, 2
        end = _CLOSE.match(text, skip)
        if not end:
            return " " * len(text), 2 if re.search(r"(?<!\\)(?:\\\\)*\\\Z", text[skip:]) else 1
        skip = end.end()
    out = " " * skip + _STRING.sub(lambda m: " " * len(m[0]), text[skip:])
    if tail := _OPEN_END.search(out):
        return out[: tail.start()] + " " * (len(out) - tail.start()), 2 if tail[1] else 1
    return out, 0


def brackets(plain: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of brackets, whether each opens, and whether it is square."""
    code = np.frombuffer(plain.encode("utf-32-le"), "<u4")
    at = np.flatnonzero(np.isin(code, np.frombuffer("{}[]".encode("utf-32-le"), "<u4")))
    kind = code[at]
    return at, (kind == ord("{")) | (kind == ord("[")), (kind == ord("[")) | (kind == ord("]"))


def effect(text: str, inside: int) -> list:
    """Last state, change of depth, lowest depth, and for each level at or below 1 the arrays opened there and whether the last opening was one."""
    plain, last = blanked(text, inside)
    _, opens, square = brackets(plain)
    after = np.cumsum(np.where(opens, 1, -1))
    before = after - np.where(opens, 1, -1)
    levels = {}
    for level in np.unique(before[opens & (before <= 1)]).tolist():
        here = square[opens & (before == level)]
        levels[str(level)] = [int(here.sum()), bool(here[-1])]
    return [last, int(after[-1]) if len(after) else 0, int(min(0, after.min())) if len(after) else 0, levels]


def _blocks(batches):
    key, parts, size, seq, n_bytes = None, [], 0, 0, 0

    def done():
        text = "".join(parts)
        return pd.DataFrame([(*key, seq, n_bytes, text, json.dumps([effect(text, s) for s in range(3)]))], columns=[c.split()[0] for c in _BLOCKS.split(", ")])

    for batch in batches:
        for district, file_size, split, value, n in zip(batch["district"], batch["file_size"], batch["split"], batch["value"], batch["n"]):
            if key != (district, file_size, split):
                if parts:
                    yield done()
                key, parts, size, seq, n_bytes = (district, file_size, split), [], 0, 0, 0
            elif size >= BLOCK:
                yield done()
                parts, size, seq, n_bytes = [], 0, seq + 1, 0
            parts += [value, "}"]
            size, n_bytes = size + len(value) + 1, n_bytes + n + 1
    if parts:
        yield done()


def _states(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state in which each block of a file starts; whether its last brace is one that the file doesn't have; whether bytes were left out."""
    pdf = pdf.sort_values(["split", "seq"])
    over = int(pdf["bytes"].sum() - pdf["file_size"].iloc[0])
    inside, depth, in_array, arrays, opened, out = 0, 0, False, 0, -1, []
    for block, row in enumerate(pdf.itertuples()):
        out.append((row.district, row.split, row.seq, block, inside, depth, in_array, arrays, opened, over == 1 and block == len(pdf) - 1, over in (0, 1)))
        last, change, lowest, levels = json.loads(row.effect)[inside]
        n, square = levels.get(str(1 - depth), (0, in_array))
        opened = block if depth + lowest <= 2 else opened
        inside, depth, in_array, arrays = last, depth + change, square, arrays + n
    return pd.DataFrame(out, columns=[c.split()[0] for c in _STATE.split(", ")])


def objects(text: str, inside: int, depth: int, in_array: bool, arrays: int) -> tuple[list[tuple], str]:
    """Objects (number of their array, start or None, end or None) of arrays in the root that lie in a block, and the text outside of them."""
    plain, _ = blanked(text, inside)
    at, opens, square = brackets(plain)
    after = depth + np.cumsum(np.where(opens, 1, -1))
    before = after - np.where(opens, 1, -1)
    tops = np.flatnonzero(opens & (before == 1))
    kinds, numbers = np.r_[in_array, square[tops]].astype(bool), arrays + np.r_[0, np.cumsum(square[tops])]
    starts, ends = np.flatnonzero(opens & ~square & (before == 2)), np.flatnonzero(~opens & (after == 2))
    home = np.searchsorted(tops, starts)
    starts, home = starts[kinds[home]], home[kinds[home]]
    found, outside, past = [], [], 0
    carried = depth > 2 and in_array
    if carried:
        end = int(at[ends[0]]) + 1 if len(ends) else None
        found.append((arrays, None, end))
        past = len(text) if end is None else end
    for s, h in zip(starts, home):
        e = np.searchsorted(ends, s)
        lo, hi = int(at[s]), int(at[ends[e]]) + 1 if e < len(ends) else None
        found.append((int(numbers[h]), lo, hi))
        outside += [text[past:lo].replace(_MARK, "\x03"), _MARK]
        past = len(text) if hi is None else hi
    outside.append(text[past:].replace(_MARK, "\x03"))
    return found, _RUN.sub(_MARK, "".join(outside))


def _found(batches):
    for batch in batches:
        for b in batch.itertuples():
            text = b.text[:-1] if b.cut else b.text
            rows = []
            found, outside = objects(text, b.inside, b.depth, b.in_array, b.arrays)
            i = 0
            for arrays, lo, hi in found:
                opened = b.opened if lo is None else b.block if hi is None else -1
                rows.append((b.district, b.block, -1 if lo is None else i, arrays, opened, "object", text[lo or 0 : hi]))
                i += lo is not None
            rows.append((b.district, b.block, 0, 0, -1, "outside" if b.sound else "unsound", outside))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")])


def _frames(pdf: pd.DataFrame) -> pd.DataFrame:
    """What a file is outside of its objects: the number of its array of features, or why it is refused."""
    district, number, message = pdf["district"].iloc[0], -1, None
    try:
        if (pdf["part"] == "unsound").any():
            raise ValueError("byte order mark or unreadable bytes")
        if pdf["size"].iloc[0] > OUTSIDE:
            raise ValueError("too much text outside of features")
        root = geojson.parse(_RUN.sub(_MARK, "".join(pdf.sort_values("block")["text"])).replace(_MARK, "{}"))
        if not isinstance(root, dict) or root.get("type") != "FeatureCollection" or not isinstance(root.get("features"), list) or not all(isinstance(f, dict) for f in root["features"]):
            raise ValueError("one FeatureCollection with an array of features is expected")
        number = [k for k, v in root.items() if isinstance(v, list)].index("features") + 1
    except (ValueError, RecursionError) as e:
        message = str(e)
    return pd.DataFrame([(district, number, message)], columns=["district", "number", "message"])


def _rows(batches):
    names = [c.split()[0] for c in geojson.FEATURE.split(", ")]
    for batch in batches:
        rows = []
        for district, pos, wanted, text in zip(batch["district"], batch["pos"], batch["wanted"], batch["text"]):
            try:
                feature = geojson.parse(text)
                if wanted:
                    rows.append(geojson.feature_row(district, int(pos), feature))
            except (ValueError, RecursionError) as e:
                rows.append(dict.fromkeys(names) | {"district": district, "pos": -1, "field": "$", "message": str(e)})
        if rows:
            out = pd.DataFrame(rows, columns=names).astype(object)
            yield out.where(out.notna(), None)


def scan(spark: SparkSession, path: str, held: list | None = None) -> DataFrame:
    """Features of all GeoJSON files under a path, as ``geojson.scan`` gives them; tables written for it are noted in held.

    A file that isn't one FeatureCollection gives one row with field $. An empty file is such a file. Only the messages of
    malformed JSON name other places than a parse of the whole file.
    """
    meta = [F.col("_metadata.file_path").alias("district"), F.col("_metadata.file_size").alias("file_size")]
    pieces = spark.read.text(path, lineSep="}").select(*meta, F.col("_metadata.file_block_start").alias("split"), "value", F.octet_length("value").alias("n"))
    blocks = pieces.mapInPandas(_blocks, _BLOCKS)
    states = shared.written(blocks.drop("text").groupBy("district").applyInPandas(_states, _STATE), "states", held)
    found = shared.written(blocks.select("district", "split", "seq", "text").join(states, ["district", "split", "seq"]).mapInPandas(_found, _FOUND), "objects", held)

    outside = found.where("part <> 'object'")
    sizes = outside.groupBy("district").agg(F.sum(F.length("text")).alias("size"))
    sized = outside.join(sizes, "district").withColumn("text", F.when(F.col("size") <= OUTSIDE, F.col("text")).otherwise(""))
    frames = sized.select("district", "block", "part", "text", "size").groupBy("district").applyInPandas(_frames, "district string, number int, message string")
    frames = shared.written(frames, "frames", held)

    objects_ = found.where("part = 'object'")
    order = Window.partitionBy("district", "arrays").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = objects_.where("i >= 0").groupBy("district", "arrays", "block").agg(F.count("*").alias("n"), F.min("i").alias("least"))
    first = counts.select("district", "arrays", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"), "least")
    whole = objects_.where("opened < 0").select("district", "arrays", "block", "i", "text")
    pieces_of = objects_.where("opened >= 0").groupBy("district", "arrays", F.col("opened").alias("home")).agg(F.max("i").alias("i"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "").alias("text"))
    placed = whole.unionByName(pieces_of.withColumnRenamed("home", "block")).join(first, ["district", "arrays", "block"]).join(frames.where("message IS NULL"), "district")
    numbered = placed.select("district", (F.col("first") + F.col("i") - F.col("least")).alias("pos"), (F.col("arrays") == F.col("number")).alias("wanted"), "text")
    rows = shared.written(numbered.mapInPandas(_rows, geojson.FEATURE), "features", held)

    empty = spark.read.format("binaryFile").load(path).select(*meta).where("file_size = 0").select("district", F.lit("empty file").alias("message"))
    refused = frames.where("message IS NOT NULL").select("district", "message").unionByName(rows.where("pos < 0").select("district", "message")).unionByName(empty)
    refused = refused.groupBy("district").agg(F.min("message").alias("message"))
    names = [c.split() for c in geojson.FEATURE.split(", ")]
    own = {"district": F.col("district"), "pos": F.lit(-1), "field": F.lit("$"), "message": F.concat(F.lit("malformed JSON: "), "message")}
    broken = refused.select(*[own.get(n, F.lit(None)).cast(t).alias(n) for n, t in names])
    return rows.join(refused.select("district"), "district", "left_anti").select(*rows.columns).unionByName(broken)
