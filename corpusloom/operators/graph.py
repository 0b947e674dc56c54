"""A property graph on tables: idempotent upserts, neighbourhoods, paths, hubs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions import ontology as O, text as X
from corpusloom.shipping import ship


def upsert_entities(rows: DataFrame) -> DataFrame:
    """(key, name, type, aliases) from rows(key, name, type, seq): the first name and type stay, names become aliases.

    Aggregates combine before the shuffle; applying the same rows again changes nothing.
    """
    return rows.groupBy("key").agg(F.min_by("name", "seq").alias("name"), F.min_by("type", "seq").alias("type"), F.array_sort(F.collect_set("name")).alias("aliases"))


def merged_entities(rows: DataFrame) -> DataFrame:
    """Rows (key, name, type, seq, aliases) of one key as one: name, type and seq of the first, all aliases; merging again changes nothing."""
    first = F.min(F.struct("seq", "name", "type"))
    one = rows.groupBy("key").agg(first.alias("x"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("aliases"))
    return one.select("key", "x.name", "x.type", "x.seq", "aliases")


def upsert_relations(rows: DataFrame) -> DataFrame:
    """(src, name, dst, confidence, provenance) from rows(src, name, dst, confidence, provenance, seq): the highest confidence, the first provenance."""
    return rows.groupBy("src", "name", "dst").agg(F.max("confidence").alias("confidence"), F.min_by("provenance", "seq").alias("provenance"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; max_by on a struct combines before the shuffle, unlike a window."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("row"))
    return picked.select(*keys, "row.*")


def neighbours(edges: DataFrame) -> DataFrame:
    """(a, b, edge) in both directions from edges(src, name, dst); edge is `src name dst`."""
    label = F.concat_ws(" ", "src", "name", "dst")
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), label.alias("edge")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), label.alias("edge")))


def paths(seeds: DataFrame, edges: DataFrame, hops: int, most: int) -> DataFrame:
    """(seed, length, path, node): undirected paths of 1 to `hops` edges without a repeated edge, the `most` shortest of each seed.

    After each hop a seed whose shorter paths already fill its limit goes no
    further: a longer path can't rank among them.
    """
    both = neighbours(edges)
    at = seeds.select("seed", F.col("seed").alias("node"), F.array().cast("array<string>").alias("edges"))
    found = None
    order = Window.partitionBy("seed").orderBy("length", "path")
    for hop in range(1, hops + 1):
        step = at.join(both, at["node"] == both["a"]).filter(~F.array_contains("edges", F.col("edge")))
        at = step.select("seed", F.col("b").alias("node"), F.array_append("edges", F.col("edge")).alias("edges"))
        own = at.select("seed", F.lit(hop).alias("length"), F.array_join("edges", " | ").alias("path"), "node")
        found = own if found is None else found.unionByName(own)
        if hop < hops:
            full = found.groupBy("seed").agg(F.count("*").alias("n")).filter(F.col("n") >= most).select("seed")
            at = at.join(full, "seed", "left_anti")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).drop("rank")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, least: int, most: int) -> DataFrame:
    return degrees(edges).filter(F.col("degree") >= least).orderBy(F.desc("degree"), "node").limit(most)


def communities(hub_rows: DataFrame, edges: DataFrame, members: int, facts: int) -> DataFrame:
    """(hub, members, n_facts): the first `members` neighbours by name among the first `facts` edges of each hub."""
    ranked = hub_rows.select(F.col("node").alias("a")).join(neighbours(edges), "a").withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy("edge"))).filter(F.col("rn") <= facts)
    return ranked.groupBy(F.col("a").alias("hub")).agg(F.slice(F.array_sort(F.collect_set("b")), 1, members).alias("members"), F.count("*").alias("n_facts"))


def seeds(questions: DataFrame, key: str, text: str, edges: DataFrame, most: int) -> DataFrame:
    """(key, seed, degree, rank): the capitalised words of a question that are nodes, those of few edges first, then as they stand."""
    said = questions.select(key, F.posexplode(F.regexp_extract_all(text, F.lit("[A-Z][A-Za-z]+"), 0)).alias("at", "node")).groupBy(key, "node").agg(F.min("at").alias("first"))
    order = Window.partitionBy(key).orderBy("degree", "first", "node")
    known = said.join(degrees(edges), "node").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return known.select(key, F.col("node").alias("seed"), "degree", "rank")


def rerank_paths(found: DataFrame, question: Column, most: int) -> DataFrame:
    """(seed, path, score, rank): the paths of each seed by the share of their words that a question has, shorter ones first among equals."""
    words = X.tokens(F.replace("path", F.lit("_"), F.lit(" ")))
    scored = found.withColumn("words", words).select("seed", "length", "path", F.round(F.size(F.filter("words", lambda w: F.array_contains(question, w))) / F.size("words"), 6).alias("score"))
    order = Window.partitionBy("seed").orderBy(F.desc("score"), "length", "path")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("seed", "path", "score", "rank")


def community_search(questions: DataFrame, key: str, text: str, edges: DataFrame, least: int, members: int, most: int) -> DataFrame:
    """(key, hub, hits, rank): the hubs (of `least` edges or more) by how many distinct words of a question their names and first members hold.

    Words and questions meet by equality, so a question meets only hubs that hold one of its words.
    """
    both = neighbours(edges)
    hub = degrees(edges).filter(F.col("degree") >= least).select(F.col("node").alias("a"))
    named = both.join(hub, "a").groupBy(F.col("a").alias("hub")).agg(F.slice(F.array_sort(F.collect_set("b")), 1, members).alias("members"))
    held = named.select("hub", F.explode(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "hub", F.array_join("members", " "))), " ", -1))).alias("word"))
    said = questions.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), 0))).alias("said"))
    hits = said.withColumn("word", F.lower("said")).join(held, "word").groupBy(key, "hub").agg(F.count("*").alias("hits"))
    order = Window.partitionBy(key).orderBy(F.desc("hits"), "hub")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def answer_context(questions: DataFrame, edges: DataFrame, chunks: DataFrame, seeds_each: int = 6, hops: int = 2, paths_each: int = 50, kept: int = 8, evidence_each: int = 3, hubs_each: int = 2, least_edges: int = 3, members: int = 50) -> DataFrame:
    """(question, seeds, facts, evidence, communities): what a graph has to say to each of questions(question, t), as lines in order.

    The chain of a graph retriever: the names in a question that are nodes, paths
    around them, the paths that share most words with the question, chunks(node,
    chunk, line, weight) of the nodes that these paths reach, the heaviest first,
    and the communities whose members the question names.  Questions without
    nodes have empty parts.  Chunks are cut to a few a node before they meet
    questions, and paths to `paths_each` a seed, so no part grows with a node's
    degree.
    """
    from corpusloom.session import cut

    start = cut(seeds(questions, "question", "t", edges, seeds_each))
    around = paths(start.select("seed").distinct(), edges, hops, paths_each)
    asked = questions.select("question", X.tokens(F.col("t")).alias("asked"))
    met = start.join(around, "seed").groupBy("question", "length", "path").agg(F.min("node").alias("node")).join(asked, "question")
    words = X.tokens(F.replace("path", F.lit("_"), F.lit(" ")))
    scored = met.withColumn("words", words).withColumn("score", F.round(F.size(F.filter("words", lambda w: F.array_contains("asked", w))) / F.size("words"), 6))
    best = cut(scored.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "length", "path"))).filter(F.col("rank") <= kept).select("question", "rank", "path", "node"))
    nodes = best.select("question", "node").unionByName(start.select("question", F.col("seed").alias("node"))).distinct()
    heaviest = [F.desc("weight"), "chunk"]
    few = chunks.withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy(*heaviest))).filter(F.col("at") <= evidence_each)
    met = nodes.join(few, "node").groupBy("question", "chunk").agg(F.max("weight").alias("weight"), F.min("line").alias("line"))
    found = met.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(*heaviest))).filter(F.col("rank") <= evidence_each)
    hubs_ = community_search(questions, "question", "t", edges, least_edges, members, hubs_each)
    lines = lambda rows, line, name: rows.groupBy("question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line))), lambda x: x[line]), "\n").alias(name))  # noqa: E731  a few rows a question
    out = questions.select("question")
    for rows, line, name in ((start, "seed", "seeds"), (best, "path", "facts"), (found, "line", "evidence"), (hubs_, "hub", "communities")):
        out = out.join(lines(rows, line, name), "question", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out


def mine_quantities(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One row a measurement found in a text."""
    ship(rows.sparkSession)
    names = [key, "property_key", "value", "unit", "raw", "base_value", "base_unit"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, *q) for k, t in zip(f[key], f[text], strict=True) for q in O.quantities(t)], columns=names)

    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, property_key string, value double, unit string, raw string, base_value double, base_unit string")


def salvage(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One row a triple (JSON) recovered from a model's answer."""
    ship(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, t) for k, raw in zip(f[key], f[text], strict=True) for t in O.salvage_triples(raw)], columns=[key, "triple"])

    return rows.select(key, text).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, triple string")


def validate_triples(rows: DataFrame, least: float = 0.0) -> DataFrame:
    """rows(chunk, pos, subject, verb, object, confidence) as canonical triples, first of each kind in its chunk.

    Ends must be there and differ (case aside), relations must mean something;
    confidence is clamped to [0, 1], 0.8 where it is missing.
    """
    s, o = F.trim("subject"), F.trim("object")
    ready = rows.select("chunk", "pos", s.alias("subject"), O.canonical_relation(F.col("verb")).alias("relation"), o.alias("object"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.8)))).alias("confidence"))
    sound = ready.filter("subject <> '' and object <> '' and lower(subject) <> lower(object) and relation is not null")
    first = Window.partitionBy("chunk", F.lower("subject"), "relation", F.lower("object")).orderBy("pos")
    kept = sound.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")
    return kept.filter((F.col("confidence") >= least) & (F.col("relation") != "RELATED_TO"))


# Fixed value: simple sentences.
SVO = r"([A-Z][A-Za-z0-9_ &-]{2,40})\s+(is|are|was|were|has|have|owns|owned|founded|acquired|developed|created|leads|manages|builds)\s+([A-Z][A-Za-z0-9_ &-]{2,40})"


def svo(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Subject, relation, object of simple sentences, confidence 0.4; verbs without meaning go."""
    groups = [F.regexp_extract_all(text, F.lit(SVO), i).alias(n) for i, n in ((1, "s"), (2, "v"), (3, "o"))]
    zipped = rows.select(key, F.explode(F.arrays_zip(*groups)).alias("t"))
    return zipped.select(key, F.trim("t.s").alias("subject"), O.canonical_relation(F.col("t.v")).alias("relation"), F.trim("t.o").alias("object"), F.lit(0.4).alias("confidence")).filter("relation is not null")


def rebuild(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(src, name, dst, mentions, chunks): the relations of simple sentences in all chunks, ends lower-cased."""
    found = svo(chunks, key, text)
    return found.groupBy(F.lower("subject").alias("src"), F.col("relation").alias("name"), F.lower("object").alias("dst")).agg(F.count("*").alias("mentions"), F.count_distinct(key).alias("chunks"))


def entity_clusters(items: DataFrame, least: float = 0.92, block: int = 2_000) -> DataFrame:
    """(id, leader) of items(id, type, v): greedy leaders among vectors of one type with a cosine (6 places) of `least` or more.

    Each type's vectors are dealt into blocks, and a pair of blocks is a task's;
    only links come out of it, which a limit as high as the default keeps few.
    Items without a vector or type lead themselves.
    """
    ship(items.sparkSession)
    kind = dict(items.dtypes)["id"]
    parts = items.groupBy("type").agg(F.ceil(F.count("*") / block).alias("parts"))
    own = items.filter("v is not null").join(parts, "type").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")))
    pairs = own.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")).select("type", "id", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        ids, side = frame["id"].to_numpy(), frame["own"].to_numpy()
        v = np.array(frame["v"].tolist(), np.float64)
        norms = np.sqrt((v * v).sum(axis=1, keepdims=True))
        v = v / np.where(norms > 0, norms, 1.0)
        a, b = [], []
        for at in range(0, len(ids), 256):
            met = (np.round(v[at : at + 256] @ v.T, 6) >= least) & (ids[at : at + 256, None] < ids[None, :])
            if frame["i"].iloc[0] != frame["j"].iloc[0]:
                met &= side[at : at + 256, None] != side[None, :]
            x, y = np.nonzero(met)
            a.append(ids[x + at]), b.append(ids[y])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    from corpusloom.session import cut

    met = cut(pairs.groupBy("type", "i", "j").applyInPandas(links, f"a {kind}, b {kind}"))
    return leader_clusters(items.select("id"), met)


def leader_clusters(items: DataFrame, pairs: DataFrame, edges_per_range: int = 1_000_000) -> DataFrame:
    """(id, leader) by greedy leaders in the order of ids, from pairs(a, b) with a < b of items alike enough and of one type.

    An item joins the least leader that it is paired with, or leads itself; it is
    settled once no earlier, still open item could come before that leader.  Every
    round range-sorts the open pairs by their later item, and each range settles in
    order all that does not wait for an earlier range, however long the chain; the
    first range settles whole.  Ranges are as few as the open pairs allow, so a rest
    of up to `edges_per_range` pairs takes one round.  A task remembers the items
    that its range has settled.
    """
    from corpusloom.session import cut

    kind = dict(items.dtypes)["id"]
    ship(items.sparkSession)
    ids = cut(items.select("id").distinct())
    open_ = cut(pairs.select(F.col("b").alias("id"), F.col("a"), F.lit(None).cast(kind).alias("of")))
    alone = ids.join(open_.select("id").distinct(), "id", "left_anti").select("id", F.col("id").alias("leader"))
    done = [cut(alone)]
    open_ = _seen(open_, done[0])
    while n := open_.count():
        ranges = -(-n // edges_per_range)
        ordered = open_.repartitionByRange(ranges, "id").sortWithinPartitions("id", "a")
        settled = cut(ordered.mapInArrow(_settle, f"id {kind}, leader {kind}"))
        done.append(settled)
        open_ = _seen(open_.join(settled.select("id"), "id", "left_anti"), settled)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def _seen(open_: DataFrame, settled: DataFrame) -> DataFrame:
    """open_(id, a, of) with the leaders that settled(id, leader) brings for a."""
    from corpusloom.session import cut

    new = settled.select(F.col("id").alias("a"), F.col("leader").alias("new"))
    return cut(open_.join(new, "a", "left").select("id", "a", F.coalesce("of", "new").alias("of")))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, leader) of the items that can be settled, from rows (id, a, of) in the order of id and a; a task's range of ids is whole."""
    own: dict = {}  # what this range has settled
    at = first = None
    blocked, kind, names = False, None, ["id", "leader"]

    def close(out: list) -> None:
        if at is not None and not blocked:
            own[at] = at if first is None else first
            out.append((at, own[at]))

    def rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x in zip(*out, strict=True)], names=names)

    for batch in batches:
        kind, out = batch.column(0).type, []
        for i, a, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if i != at:
                close(out)
                at, first, blocked = i, None, False
            if first is not None or blocked:
                continue  # an earlier partner has decided
            of = own.get(a) if of is None else of
            if of is None:
                blocked = True  # a could yet lead, and would come first
            elif of == a:
                first = a
        if out:
            yield rows(out)
    out = []
    close(out)
    if out:
        yield rows(out)
