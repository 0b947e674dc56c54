"""Cutting documents into chunks, and routing files by format."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions import patterns as P
from corpusloom.shipping import ship


def fixed_windows(docs: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """One row a window (idx, chunk) of `size` characters, each starting `size - overlap` after the last; an empty text is one empty window."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(text), F.lit(1)) - 1, F.lit(step))
    cut = docs.withColumn("start", F.explode(starts))
    return cut.select(*[c for c in docs.columns if c != text], (F.col("start") / step).cast("int").alias("idx"), F.substr(text, F.col("start") + 1, F.lit(size)).alias("chunk"))


def chunk_id(source: Column, idx: Column, chunk: Column) -> Column:
    """Stable id from the source, the true position in it and the first 64 characters."""
    return F.substring(F.sha1(F.concat_ws("|", source, idx.cast("string"), F.substring(chunk, 1, 64))), 1, 16)


def header_sections(docs: DataFrame, text: str) -> DataFrame:
    """One row a section (pos, level, header, section), cut before lines of one to three number signs; blank sections go."""
    marked = F.regexp_replace(F.col(text), r"(^|\n)(#{1,3} )", "$1\u0001$2")
    parts = F.filter(F.split(marked, "\u0001", -1), lambda x: F.trim(x) != "")
    return docs.select(*[c for c in docs.columns if c != text], F.posexplode(parts).alias("pos", "section")).withColumns({"level": F.regexp_extract("section", r"^(#{1,3}) ", 1), "header": F.regexp_extract("section", r"^#{1,3} ([^\n]*)", 1)})


SEPARATORS = ["\n\n", "\n", ". ", " "]
#: What no cut may go through: display and inline formulas, and runs of table rows.
_FORMULA = re.compile(r"\$\$.*?\$\$|(?<!\$)\$[^$\n]+\$(?!\$)", re.DOTALL)
_TABLE_ROW = re.compile(r"[ \t]*\|[^\n]*\|[ \t]*")
_HEADING = re.compile(r"\A(?:\s*#{1,6}[^\n]*\n)+")


def whole_spans(text: str) -> list[tuple[int, int]]:
    """Where formulas and tables stand; a table's rows each begin and end with a bar."""
    out = [m.span() for m in _FORMULA.finditer(text)]
    at = 0
    rows: list[tuple[int, int]] = []
    for line in text.splitlines(keepends=True):
        if _TABLE_ROW.fullmatch(line.rstrip("\n")):
            rows = [(rows[0][0], at + len(line))] if rows else [(at, at + len(line))]
        elif rows:
            out, rows = [*out, *rows], []
        at += len(line)
    merged: list[tuple[int, int]] = []
    for a, b in sorted([*out, *rows]):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def split_text(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that helps and never inside a formula or table.

    A formula or table over `size` is a piece of its own.  Each piece but the
    first repeats the end of the one before, up to `overlap` characters of whole
    parts, and begins with the text's heading lines if it has any and they leave
    room: pieces are cut that much shorter, and headings of over half of `size`
    are not repeated.  A text of at most `size` is one piece; a blank one is none.
    """
    if len(text) <= size:
        return [text] if text.strip() else []
    heading = found[0] if (found := _HEADING.match(text)) else ""
    if 2 * len(heading) > size:
        heading = ""
    size -= len(heading)

    def parts(t: str, level: int) -> list[str]:
        if len(t) <= size:
            return [t]
        if level == len(SEPARATORS):
            return [t[k : k + size] for k in range(0, len(t), size)]
        sep = SEPARATORS[level]
        cut = t.split(sep)
        return [y for k, x in enumerate(cut) for y in parts(x + (sep if k < len(cut) - 1 else ""), level + 1) if y]

    def fine(t: str) -> list[str]:
        """Parts at the coarsest separators, those cut again that are longer than the overlap, so that its end can be repeated."""
        return [y for x in parts(t, 0) for y in (re.findall(r"(?s).+?(?:\. |\n|$)", x) if len(x) > overlap else [x])]

    atoms, at = [], 0
    for a, b in [*whole_spans(text), (len(text), len(text))]:
        if a > at:
            atoms += fine(text[at:a])
        if b > a:
            atoms.append(text[a:b])
        at = b
    pieces: list[list[str]] = [[]]
    n = 0
    for x in atoms:
        if n and n + len(x) > size:
            tail: list[str] = []
            room = min(overlap, size - len(x))
            for y in reversed(pieces[-1]):
                if sum(map(len, tail)) + len(y) > room:
                    break
                tail.insert(0, y)
            pieces.append(tail)
            n = sum(map(len, tail))
        pieces[-1].append(x)
        n += len(x)
    made = ["".join(p) for p in pieces]
    return [p if k == 0 or p.startswith(heading) else heading + p for k, p in enumerate(made) if p.strip()]


def safe_windows(docs: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """docs with idx and chunk in the place of `text`: the pieces of split_text, which cut no formula or table; only texts go through Python."""
    ship(docs.sparkSession)
    cut = F.pandas_udf(lambda texts: texts.map(lambda t: split_text(t or "", size, overlap)), "array<string>")
    return docs.select("*", F.posexplode(cut(text)).alias("idx", "chunk")).drop(text)


def recursive_split(docs: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """(doc_id, parent_id, section_part, chunk): every document cut by split_text; parent_id is a hash of its whole text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, p, k, c) for d, p, t in zip(f["doc_id"], f["parent_id"], f["text"], strict=True) for k, c in enumerate(split_text(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "parent_id", "section_part", "chunk"])

    ship(docs.sparkSession)
    keyed = docs.select("doc_id", F.substring(F.sha1(F.coalesce(F.col(text), F.lit(""))), 1, 16).alias("parent_id"), F.col(text).alias("text"))
    return keyed.mapInPandas(run, "doc_id long, parent_id string, section_part int, chunk string")


def concat_by(rows: DataFrame, key: str, order: str, text: str, most: int) -> DataFrame:
    """Texts of a key joined by blank lines in order, cut at `most` characters, and their number.

    Every text adds two characters at least, so the first most / 2 + 1 rows of a
    key are enough; the limit is applied before rows of a key are brought together.
    """
    enough = most // 2 + 1
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("rn") <= enough)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col("rn"), F.substring(text, 1, most).alias("t")))), lambda x: x["t"])
    joined = first.groupBy(key).agg(F.substring(F.array_join(ordered, "\n\n"), 1, most).alias("joined"))
    return joined.join(rows.groupBy(key).agg(F.count("*").alias("n")), key)


def route_formats(files: DataFrame, switches: set[str]) -> DataFrame:
    """files(path, ...) with source_type, category, gated and enabled by suffix; unknown suffixes are disabled."""
    registry = files.sparkSession.createDataFrame(P.FORMATS, "sfx string, source_type string, category string, gated boolean, switch string, page_numbers boolean")
    suffix = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    joined = files.join(F.broadcast(registry), suffix == F.col("sfx"), "left")  # the registry is a constant of a few rows
    return joined.withColumn("enabled", F.col("sfx").isNotNull() & (F.col("switch").isNull() | F.col("switch").isin(*switches))).drop("sfx")


def metadata_defaults(files: DataFrame, ocr: tuple[str, ...] = ()) -> DataFrame:
    """files(path, page, ...) with source_type (unknown for other suffixes), page only where the format keeps page numbers, and forced_ocr where the path holds one of `ocr`, case aside."""
    registry = files.sparkSession.createDataFrame([(f[0], f[1], f[5]) for f in P.FORMATS], "sfx string, source_type string, page_numbers boolean")
    joined = files.join(F.broadcast(registry), F.lower(F.regexp_extract("path", r"\.[^./]+$", 0)) == F.col("sfx"), "left")  # the registry is a constant of a few rows
    forced = F.lit(False)
    for part in ocr:
        forced = forced | F.lower("path").contains(part.lower())
    return joined.withColumns({"source_type": F.coalesce("source_type", F.lit("unknown")), "page": F.when(F.coalesce("page_numbers", F.lit(False)), F.col("page")), "forced_ocr": forced}).drop("sfx", "page_numbers")
