"""Benchmark decontamination by winnowing, with DataFrame functions only.

A text's fingerprints are the hashes of its k-grams that are the least of some
window of w neighbours.  Equal spans of k + w - 1 words hold equal windows, so
they share a fingerprint: with k = 5 and w = 9 every shared span of 13 words is
met.  Documents and benchmark items are joined on fingerprints, and each meeting
is extended word by word to both sides; spans that reach 13 words are hits.

An item of fewer than 13 words counts as a whole.  It is met through the hash of
its first words (up to five), without winnowing, and compared in full.

A meeting carries the few words around it that an extension can reach, never the
document.  A k-gram that stands in over ``common`` places of the benchmark is not
joined by itself, as every document that holds it would meet all those places:
there the windows of 13 words around it (or, of items that count as a whole, the
whole items) are joined by their hash, so that only true hits come out.

Benchmarks are small beside corpora.  Up to ``in_row`` distinct fingerprints
they are tested where a document is read (first membership, then whether the
k-gram is a winnowed one), so only documents that meet a benchmark carry their
words on.  Beyond it the winnowed fingerprints of all documents are shuffled and
joined, and the words follow for the documents that met one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.words import spaced_words, word_array
from corpusloom.llm.workspace import cut


@dataclass(frozen=True)
class WinnowSpec:
    """span: words of a window; gram: words of a k-gram; in_row: fingerprints tested in place; broadcast_rows: benchmark rows sent to all tasks; common: places of a k-gram beyond which its windows are joined.

    A document is contaminated if it has a hit and hits are at least 1/share of its words.
    """

    span: int = 13
    gram: int = 5
    share: int = 20
    in_row: int = 20_000
    broadcast_rows: int = 200_000
    common: int = 64

    @property
    def window(self) -> int:
        return self.span - self.gram + 1


def _hash(words: str, at: str, n: int) -> str:
    return "xxhash64(" + ", ".join(f"get({words}, {at} + {k})" for k in range(n)) + ")"


def _positions(words: str, n: int) -> str:
    """All starts of n words; none for fewer words."""
    return f"if(size({words}) < {n}, array(), sequence(0, size({words}) - {n}))"


def _winnowed(words: str, at: str, spec: WinnowSpec) -> str:
    """Whether the k-gram at a position is the least of some window; ties all count."""
    k, w = spec.gram, spec.window
    own = _hash(words, at, k)

    def run(sign: str, outside: str) -> str:
        other = _hash(words, f"{at} {sign} j", k)
        return f"coalesce(nullif(array_position(transform(sequence(1, {w - 1}), j -> {outside} or {other} < {own}), true), 0), {w}) - 1"

    left, right = run("-", f"{at} - j < 0"), run("+", f"{at} + j > size({words}) - {k}")
    return f"({left} + {right} + 1 >= {w})"


def benchmark_prints(benchmark: DataFrame, spec: WinnowSpec = WinnowSpec()) -> DataFrame:
    """(n, hash, item_id, at, words, whole): where each fingerprint stands, among the words around it that an extension can reach.

    whole marks items of fewer words than a span.  Items without words have none.
    """
    items = benchmark.select("item_id", word_array(spaced_words(F.col("text"))).alias("words")).filter("size(words) > 0")
    long = items.filter(F.size("words") >= spec.span).select(
        F.lit(spec.gram).alias("n"), "item_id", "words", F.lit(False).alias("whole"), F.explode(F.expr(f"filter({_positions('words', spec.gram)}, i -> {_winnowed('words', 'i', spec)})")).alias("at")
    )
    short = items.filter(F.size("words") < spec.span).select(F.least(F.size("words"), F.lit(spec.gram)).alias("n"), "item_id", "words", F.lit(True).alias("whole"), F.lit(0).alias("at"))
    near = long.unionByName(short).select("n", "item_id", F.expr(_local("at", spec)).alias("at"), F.expr(_around("words", "at", spec)).alias("words"), "whole").distinct()
    hashes = F.coalesce(*[F.when(F.col("n") == n, F.expr(_hash("words", "at", n))) for n in range(1, spec.gram + 1)])
    return near.withColumn("hash", hashes).select("n", "hash", "item_id", "at", "words", "whole")


def _around(words: str, at: str, spec: WinnowSpec) -> str:
    """The words that an extension from a k-gram at this place can reach."""
    most = spec.span - spec.gram
    return f"slice({words}, greatest({at} - {most}, 0) + 1, {spec.span + most})"


def _local(at: str, spec: WinnowSpec) -> str:
    """Where the k-gram stands in the words around it."""
    return f"least({at}, {spec.span - spec.gram})"


def _seeds(spec: WinnowSpec, sets: dict[tuple[int, bool], list[int]]) -> str:
    """array<struct<n, hash, at>> of a document's words that are fingerprints of the benchmark."""
    found = []
    for (n, whole), hashes in sorted(sets.items()):
        listed = ", ".join(f"{h}L" if h > -(1 << 63) else "(-9223372036854775807L - 1L)" for h in hashes)
        at = f"filter({_positions('words', n)}, i -> {_hash('words', 'i', n)} in ({listed}))"
        if not whole:
            at = f"filter({at}, i -> {_winnowed('words', 'i', spec)})"
        found.append(f"transform({at}, i -> struct({n} as n, {_hash('words', 'i', n)} as hash, i as at))")
    return f"array_distinct(concat({', '.join(found)}))"


def _runs(spec: WinnowSpec) -> tuple[str, str]:
    """How many words agree before and after a meeting, as far as a window through it can reach."""
    most, own = spec.span - spec.gram, _local("doc_at", spec)

    def run(step: str, doc_first: str, item_first: str) -> str:
        # equality with get() past an end is null, which ends the run like a difference
        other = f"coalesce(get(around, {doc_first} {step} j) <> get(words, {item_first} {step} j), true)"
        return f"coalesce(nullif(array_position(transform(sequence(1, {most}), j -> {other}), true), 0), {most + 1}) - 1"

    k = spec.gram - 1
    return run("-", own, "at"), run("+", f"{own} + {k}", f"at + {k}")


def _windows(words: str, at: str, sizes: str, base: str, spec: WinnowSpec) -> str:
    """array<struct<size, start, key>>: the runs of words (of these sizes) that a common k-gram at a place is joined by; starts count from base.

    Of a k-gram of a long item all windows of `span` words through it, of an item that counts as a whole those that begin with it.
    """
    shifts = f"if(whole, array(0), sequence(0, least({at}, {spec.span - spec.gram})))"
    each = f"transform({shifts}, j -> struct(z as size, {at} - j + {base} as start, xxhash64(array_join(slice({words}, {at} - j + 1, z), ' ')) as key, size(slice({words}, {at} - j + 1, z)) = z as full))"
    return f"filter(flatten(transform({sizes}, z -> {each})), x -> x.full)"


def contamination(docs: DataFrame, benchmark: DataFrame, spec: WinnowSpec = WinnowSpec()) -> DataFrame:
    """One row a document: (doc_id, text_key, n_words, spans, items, n_hit, contaminated).

    spans: distinct [start, stop) word ranges that stand in the benchmark, overlaps
    included; items: distinct ids of the items met; text_key: xxhash64 of the text.
    Null and wordless texts have no words and no hits; repeated rows all return;
    null doc_ids are kept; hits with items of a null id count, without an id.
    An empty benchmark contaminates nothing.  Other columns are ignored.
    """
    spark = docs.sparkSession
    prints = cut(benchmark_prints(benchmark, spec))
    n_rows = prints.count()
    small = n_rows <= spec.broadcast_rows
    few = spec.in_row >= 0 and n_rows <= 50 * max(1, spec.in_row) and prints.select("n", "whole", "hash").distinct().count() <= spec.in_row
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), word_array(spaced_words(F.col("text"))).alias("words"))
    nothing = "cast(array() as array<struct<n:int,hash:bigint,at:int>>)"
    if few:
        sets: dict[tuple[int, bool], list[int]] = {}
        for r in prints.select("n", "whole", "hash").distinct().collect():  # at most in_row rows, checked above
            sets.setdefault((r["n"], r["whole"]), []).append(r["hash"])
        met = base.withColumn("seeds", F.expr(_seeds(spec, sets)) if sets else F.expr(nothing))
    else:
        own = []
        for n in range(1, spec.gram + 1):
            at = _positions("words", n)
            own.append(f"transform({at}, i -> struct({n} as n, {_hash('words', 'i', n)} as hash, i as at))")
        wanted = [own[n - 1] for n in sorted({r["n"] for r in prints.filter("whole").select("n").distinct().collect()})]
        w = spec.window
        wanted.append(f"transform(filter(if(size(grams) = 0, array(), sequence(0, size(grams) - 1)), i -> array_contains(slice(leasts, greatest(i - {w - 1}, 0) + 1, {w}), grams[i])), i -> struct({spec.gram} as n, grams[i] as hash, i as at))")
        base_grams = base.withColumn("grams", F.expr(f"transform({_positions('words', spec.gram)}, i -> {_hash('words', 'i', spec.gram)})")).withColumn(
            "leasts", F.expr(f"if(size(grams) < {w}, cast(array() as array<bigint>), transform(sequence(0, size(grams) - {w}), i -> array_min(slice(grams, i + 1, {w}))))")
        )
        keyed = base_grams.select("doc_id", "text_key", F.explode(F.expr(f"array_distinct(concat({', '.join(wanted)}))")).alias("s")).distinct()
        hits = keyed.join(prints.select("n", "hash").distinct(), (F.col("s.n") == F.col("n")) & (F.col("s.hash") == F.col("hash")), "left_semi")
        seeds = hits.groupBy("doc_id", "text_key").agg(F.collect_set("s").alias("seeds")).withColumnsRenamed({"doc_id": "d", "text_key": "t"})
        met = base.join(seeds, base["doc_id"].eqNullSafe(seeds["d"]) & base["text_key"].eqNullSafe(seeds["t"]), "left").drop("d", "t").withColumn("seeds", F.coalesce("seeds", F.expr(nothing)))
    near = F.expr(f"transform(seeds, s -> struct(s.n as n, s.hash as hash, s.at as at, {_around('words', 's.at', spec)} as around))")
    carried = met.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), F.posexplode_outer(near).alias("nth", "seed"))
    carried = carried.select("doc_id", "text_key", "n_words", "nth", F.col("seed.n").alias("n"), F.col("seed.hash").alias("hash"), F.col("seed.at").alias("doc_at"), F.col("seed.around").alias("around"))
    groups = prints.groupBy("n", "hash", "whole").agg(F.count("*").alias("places"), F.collect_set(F.when(F.col("whole"), F.size("words")).otherwise(F.lit(spec.span))).alias("sizes"))
    common = cut(groups.filter(F.col("places") > spec.common).select("n", "hash", "whole", "sizes"))
    any_common = not common.isEmpty()
    if any_common:
        carried = cut(carried)
    sent = F.broadcast if small else lambda x: x
    rare = prints.join(sent(common), ["n", "hash", "whole"], "left_anti").groupBy("n", "hash").agg(F.collect_list(F.struct("item_id", "at", "words", "whole")).alias("places"))  # `common` of each kind at most
    parted = carried.join(sent(rare), ["n", "hash"], "left").select("doc_id", "text_key", "n_words", "nth", "doc_at", "around", F.posexplode_outer("places").alias("k", "place")).select("*", "place.item_id", "place.at", "place.words", "place.whole")
    before, after = _runs(spec)
    span = "struct<start:int,stop:int>"
    ranged = parted.withColumns({"before": F.when(~F.col("whole"), F.expr(before)), "after": F.when(~F.col("whole"), F.expr(after))})
    hit = F.when(F.col("whole") & (F.expr(f"slice(around, {_local('doc_at', spec)} + 1, size(words))") == F.col("words")), F.struct(F.col("doc_at").alias("start"), (F.col("doc_at") + F.size("words")).alias("stop"))).when(
        ~F.col("whole") & (F.col("before") + F.col("after") + spec.gram >= spec.span), F.struct((F.col("doc_at") - F.col("before")).alias("start"), (F.col("doc_at") + spec.gram + F.col("after")).alias("stop"))
    )
    # `row` marks one row of each document, however many fingerprints and places it meets
    row = ((F.coalesce("nth", F.lit(0)) == 0) & (F.coalesce("k", F.lit(0)) == 0)).cast("long")
    hits = ranged.select("doc_id", "text_key", "n_words", "item_id", hit.cast(span).alias("hit"), row.alias("row"))
    if any_common:
        first = f"doc_at - {_local('doc_at', spec)}"
        mine = carried.filter("n is not null").join(sent(common), ["n", "hash"]).select("doc_id", "text_key", "n_words", "whole", "around", F.expr(first).alias("first"), F.explode(F.expr(_windows("around", _local("doc_at", spec), "sizes", first, spec))).alias("w"))
        mine = mine.select("doc_id", "text_key", "n_words", "whole", F.col("w.size").alias("size"), F.col("w.key").alias("key"), F.col("w.start").alias("start"), F.expr("slice(around, w.start - first + 1, w.size)").alias("run"))
        theirs = prints.join(sent(common), ["n", "hash", "whole"], "left_semi").select("item_id", "whole", "words", F.explode(F.expr(_windows("words", "at", f"array(if(whole, size(words), {spec.span}))", "0", spec))).alias("w"))
        theirs = theirs.select("item_id", "whole", F.col("w.size").alias("size"), F.col("w.key").alias("key"), F.expr("slice(words, w.start + 1, w.size)").alias("held")).distinct()
        same = mine.join(sent(theirs), ["whole", "size", "key"]).filter(F.col("run") == F.col("held"))
        hits = hits.unionByName(same.select("doc_id", "text_key", "n_words", "item_id", F.expr(f"cast(struct(start, start + size) as {span})").alias("hit"), F.lit(0).cast("long").alias("row")))
    per_doc = hits.groupBy("doc_id", "text_key", "n_words").agg(F.sum("row").alias("rows"), F.collect_set("hit").alias("spans"), F.collect_set(F.when(F.col("hit").isNotNull(), F.col("item_id"))).alias("items"))
    n_hit = F.expr("aggregate(array_sort(spans), struct(cast(0 as bigint) as n, 0 as reach), (a, x) -> struct(a.n + greatest(0, x.stop - greatest(x.start, a.reach)) as n, greatest(a.reach, x.stop) as reach), a -> a.n)")
    out = per_doc.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * spec.share >= F.col("n_words")))
    return out.select("doc_id", "text_key", "n_words", "spans", "items", "n_hit", "contaminated", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy")).drop("copy")
