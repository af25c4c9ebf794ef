"""Entity resolution: exact identity keys, similar titles within an institution, and first come, first kept.

Nothing ambiguous is merged. Exact keys are joined by value. Similar titles are found by their rarest grams: an
edit changes at most GRAM of the grams of a title, so two titles at most d edits apart share one of the GRAM * d + 1
rarest of either (in one order of rarity for all), which keeps what many titles have in common, such as "introduction
to", out of the join. Only the distinct titles of an institution are compared."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import norm_title, similarity
from millrace.functions.urls import canonical
from millrace.operators.tables import components, materialize

THRESHOLD = 0.88
#: Characters of a gram.
GRAM = 3
#: The columns of a title's shape.
SHAPE = ("low", "high")
#: Candidates of a chain that one task folds at a time.
FOLD = 200_000
#: The catalog's places (kind 0) come before those of all candidates.
EARLIER = "existing.kind = 0 or existing.pos < pos"
KINDS = ("url", "institution+code", "institution+title", "platform+code")


def identity_keys(df: DataFrame) -> Column:
    """array<struct<rank, kind, value>> of the keys a record has, strongest first. df: a record's normalised parts, as of
    keyed()."""
    institution, given = F.col("institution"), lambda name: F.col(f"has_{name}")
    n = lambda name: F.coalesce(name, F.lit("null"))
    values = (
        F.col("url"),
        F.when(institution.isNotNull() & given("course_code"), F.concat_ws("|", institution, n("course_code"))),
        F.when(institution.isNotNull() & given("title"), F.concat_ws("|", institution, n("title"))),
        F.when(given("platform") & given("course_code"), F.concat_ws("|", n("platform"), n("course_code"))),
    )
    keys = [F.struct(F.lit(i).alias("rank"), F.lit(kind).alias("kind"), v.alias("value")) for i, (kind, v) in enumerate(zip(KINDS, values))]
    return F.filter(F.array(*keys), lambda k: k.value.isNotNull())


def keyed(df: DataFrame, pos: str = "pos") -> DataFrame:
    """The keys of records, one a row; each part of a record is normalised once."""
    parts = ("institution", "title", "course_code", "platform")
    given = [(F.coalesce(F.col(x), F.lit("")) != "").alias(f"has_{x}") for x in parts]
    plain = df.select(pos, canonical(F.col("url_official")).alias("url"), *[norm_title(F.col(x)).alias(x) for x in parts], *given)
    return plain.select(pos, F.inline(identity_keys(plain)))


def exact_matches(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """pos, existing (the catalog's pos), by: each candidate's match by its strongest matching key, first in
    catalog order. Both have pos; the first record of a key is found before the join."""
    return _best(_hits(candidates, _firsts(catalog)))


def _firsts(catalog: DataFrame) -> DataFrame:
    """kind, value, existing: the first record of each key."""
    return keyed(catalog).groupBy("kind", "value").agg(F.min("pos").alias("existing"))


def _hits(candidates: DataFrame, firsts: DataFrame) -> DataFrame:
    return keyed(candidates).join(firsts, ["kind", "value"])


def _best(hits: DataFrame) -> DataFrame:
    best = hits.groupBy("pos").agg(F.min(F.struct("rank", "existing", "kind")).alias("b"))
    return best.select("pos", "b.existing", F.col("b.kind").alias("by"))


def _edits(length: Column, threshold: float) -> Column:
    """The most edits two titles may differ by, the longer of this length."""
    return F.floor(length * (1 - threshold) + 1e-9).cast("int")


def _grams(titles: DataFrame) -> DataFrame:
    """block, t, gram and nth of the grams of titles (block, t): the nth of its kind in t. Marks before the title
    make as many grams as it has characters."""
    marked = F.concat(F.lit("^" * (GRAM - 1)), F.col("t"))
    cut = F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.substring(marked, i, F.lit(GRAM)))
    one = titles.select("block", "t", F.explode(cut).alias("gram")).groupBy("block", "t", "gram").agg(F.count("*").cast("int").alias("n"))
    return one.select("block", "t", "gram", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth"))


def similar_titles(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """block, a, b, score of distinct titles of left (block, t) and right (block, t) of one block whose
    similarity is at least threshold. t: normalised titles, neither null nor empty."""
    sides = left.select("block", "t", F.lit(0).alias("side")).unionByName(right.select("block", "t", F.lit(1).alias("side"))).distinct()
    sides = sides.join(left.select("block").distinct(), "block", "left_semi")
    titles = materialize(sides.groupBy("block", "t").agg(F.max(F.col("side") == 0).alias("is_left"), F.max(F.col("side") == 1).alias("is_right")))
    grams = materialize(_grams(titles))
    # normalised titles are of 37 characters, so there are at most 38 ** 3 grams
    frequency = grams.where("nth = 1").groupBy("gram").agg(F.count("*").alias("titles"))
    order = F.struct("titles", "gram", "nth")
    ranked = grams.join(F.broadcast(frequency), "gram").groupBy("block", "t").agg(F.collect_list(order).alias("grams"), *_shape(F.col("gram")))
    # the partner may be longer, and the more edits be allowed
    most = _edits(F.floor(F.length("t") / threshold + 1e-9), threshold)
    rarest = F.slice(F.sort_array("grams"), F.lit(1), GRAM * most + 1)
    shape = F.struct(F.length("t").alias("n"), *SHAPE)
    kept = ranked.join(titles, ["block", "t"]).withColumn("digits", _digits(F.col("t")))
    keys = materialize(kept.select("block", "t", "is_left", "is_right", "digits", shape.alias("shape"), F.inline(rarest)).drop("titles"))
    a = keys.where("is_left").select("block", "gram", "nth", F.col("shape").alias("x"), F.col("t").alias("a"), F.col("digits").alias("da"))
    b = keys.where("is_right").select("block", "gram", "nth", F.col("shape").alias("y"), F.col("t").alias("b"), F.col("digits").alias("db"))
    # under a gram, shapes are compared first, each once, and then titles of shapes that may be that near
    at = ["block", "gram", "nth"]
    shapes = a.select(*at, "x").distinct().join(b.select(*at, "y").distinct(), at).where(_may_be_near(F.col("x"), F.col("y"), threshold))
    longer = F.greatest(F.length("a"), F.length("b"))
    fewer = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y)))) <= F.col("d")
    met = a.join(shapes, [*at, "x"]).join(b, [*at, "y"]).withColumn("d", _edits(longer, threshold)).where(fewer("da", "db") & fewer("db", "da"))
    # the distance stops where it is beyond the edits allowed, and is -1 then; pairs are tested before they are made
    # distinct, and written, so that the score is made of distances and not of titles
    near = materialize(met.withColumn("e", F.expr("levenshtein(a, b, d)")).where("e >= 0").select("block", "a", "b", "e").distinct())
    return near.select("block", "a", "b", (1 - F.col("e") / longer).alias("score")).where(F.col("score") >= threshold)


def _digits(t: Column) -> Column:
    """How often each digit is in a title, six times at most, as that many bits: an edit takes one away, and adds one."""
    often = lambda i: F.least(F.length(t) - F.length(F.replace(t, F.lit(str(i)), F.lit(""))), F.lit(6))
    bits = [F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("long"), often(i)) - 1, F.lit(6 * i)) for i in range(10)]
    return reduce(Column.bitwiseOR, bits)


def _shape(gram: Column) -> list[Column]:
    """The grams without digits as two sets of bits: titles that differ in numbers alone are of one shape."""
    bit = F.pmod(F.xxhash64(gram), F.lit(128)).cast("int")
    own = lambda i: (bit >= 64 * i) & (bit < 64 * (i + 1)) & ~gram.rlike("[0-9]")
    return [F.bit_or(F.when(own(i), F.call_function("shiftleft", F.lit(1).cast("long"), bit - 64 * i)).otherwise(F.lit(0).cast("long"))).alias(name) for i, name in enumerate(SHAPE)]


def _may_be_near(x: Column, y: Column, threshold: float) -> Column:
    """Whether titles of two shapes can be so few edits apart: an edit takes at most GRAM grams away, and adds as many."""
    most = _edits(F.greatest(x.n, y.n), threshold)
    beyond = lambda x, y: sum(F.bit_count(x[s].bitwiseAND(F.bitwise_not(y[s]))) for s in SHAPE)
    return (F.abs(x.n - y.n) <= most) & (beyond(x, y) <= GRAM * most) & (beyond(y, x) <= GRAM * most)


def ambiguous_matches(candidates: DataFrame, catalog: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """pos, existing, score: the first catalog record, in order, with a similar title in the candidate's
    institution; a candidate without institution is compared with all titles."""
    titled = lambda df: df.select("pos", norm_title(F.col("institution")).alias("block"), norm_title(F.col("title")).alias("t")).where("t is not null")
    c = titled(candidates)
    first = titled(catalog)
    everywhere = lambda df: df.withColumn("block", F.lit("*"))
    own = first.where("block is not null").withColumn("block", F.concat(F.lit("="), "block"))
    c = c.withColumn("block", F.coalesce(F.concat(F.lit("="), "block"), F.lit("*")))
    table = own.unionByName(everywhere(first)).groupBy("block", "t").agg(F.min("pos").alias("existing"))
    pairs = similar_titles(c.select("block", "t"), table.select("block", "t"), threshold)
    scored = pairs.join(table.withColumnRenamed("t", "b"), ["block", "b"]).select("block", "a", "existing", "score")
    best = scored.groupBy("block", F.col("a").alias("t")).agg(F.min(F.struct("existing", "score")).alias("m"))
    return c.join(best, ["block", "t"]).select("pos", "m.existing", "m.score")


def classify(candidates: DataFrame, catalog: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """pos, match (exact, ambiguous, none), by, existing_kind (catalog or candidate), existing (its pos), score.

    A candidate is compared with the catalog and with the earlier candidates that were kept. Whoever matches the
    catalog is not kept. The rest is settled in rounds: a candidate that is the first undecided one under all its keys and
    similar titles is kept, and those that meet a kept earlier one go. Most are settled at once; what is left are
    chains, each waiting for the one before. When a round settles less than half, the chains are folded in order instead,
    each connected group in one task, FOLD candidates at a time: a prefix of a group depends on nothing behind it."""
    named = materialize(candidates)
    base = named.select("pos", "institution", "title", "course_code", "platform", "url_official")
    order = materialize(catalog.select("pos", "institution", "title", "course_code", "platform", "url_official"))
    firsts = materialize(_firsts(order))
    unkeyed = materialize(base.join(_hits(base, firsts).select("pos").distinct(), "pos", "left_anti"))
    # titles are compared where no key has decided, and with the catalog once
    alike = materialize(ambiguous_matches(unkeyed, order, threshold))
    open_ = materialize(unkeyed.join(alike, "pos", "left_anti"))
    kept = materialize(first_come(_blocks(open_, threshold), open_.select("pos")))
    return _final(base, firsts, alike, kept, threshold)


def first_come(keys: DataFrame, members: DataFrame, fold: int = FOLD) -> DataFrame:
    """pos of the members (pos) that are kept, in the order of pos: one is, unless it is in a block of keys (pos, block,
    leads) that a kept earlier one leads."""
    keys, undecided = materialize(keys), members.select("pos")
    kept, before, chained = None, None, False
    while True:
        live = keys.join(undecided, "pos")
        if not chained:
            least = live.where("leads").groupBy("block").agg(F.min("pos").alias("first"))
            waits = live.join(least, "block").where("pos > first").select("pos").distinct()
            now = materialize(undecided.join(waits, "pos", "left_anti"))
            hit = keys.where("leads").join(now, "pos").groupBy("block").agg(F.min("pos").alias("first"))
            gone = live.join(hit, "block").where("pos > first").select("pos").distinct()
        else:
            settled = materialize(_folded(live, fold))
            now = settled.where("kept").select("pos")
            hit = keys.where("leads").join(now, "pos").groupBy("block").agg(F.min("pos").alias("first"))
            gone = live.join(hit, "block").where("pos > first").select("pos").unionByName(settled.where("not kept").select("pos")).distinct()
        kept = now if kept is None else kept.unionByName(now)
        undecided = materialize(undecided.join(now, "pos", "left_anti").join(gone, "pos", "left_anti"))
        left = undecided.count()
        if not left:
            return kept
        chained = chained or (before is not None and 2 * left > before)
        before = left


def _folded(live: DataFrame, most: int) -> DataFrame:
    """pos and kept of the first members, most of them, of each group of undecided ones that blocks connect."""
    live = materialize(live.withColumn("node", F.xxhash64("block")))  # equal hashes make a group larger, nothing else
    # nodes: members are even numbers, blocks odd ones
    member, block = F.shiftleft("pos", 1), F.col("node").bitwiseOR(F.lit(1))
    grouped = components(live.select(member.alias("a"), block.alias("b")))
    of = grouped.where("node % 2 = 0").select(F.shiftright("node", 1).alias("pos"), F.col("component").alias("group"))
    turn = F.row_number().over(Window.partitionBy("group").orderBy("pos"))
    first = of.withColumn("turn", turn).where(F.col("turn") <= most).select("pos", "group")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        led: set[str] = set()
        out = []
        for pos, own in rows.sort_values("pos").groupby("pos", sort=False):
            kept = led.isdisjoint(own["block"])
            if kept:
                led.update(own["block"][own["leads"]])
            out.append((pos, kept))
        return pd.DataFrame(out, columns=["pos", "kept"])

    return live.select("pos", "block", "leads").join(first, "pos").groupBy("group").applyInPandas(fold, "pos long, kept boolean")


def _blocks(open_: DataFrame, threshold: float) -> DataFrame:
    """pos, block, leads: candidates that share a block, one of which leads it, are matches. A block is a key,
    or a title with those similar to it."""
    exact = keyed(open_).select("pos", F.concat_ws("\n", "kind", "value").alias("block"), F.lit(True).alias("leads"))
    t = open_.select("pos", norm_title(F.col("institution")).alias("i"), norm_title(F.col("title")).alias("t")).where("t is not null")
    # a candidate with an institution looks in it; one without looks everywhere
    all_titles = t.select(F.lit("*").alias("block"), "t").unionByName(t.where("i is not null").select(F.concat(F.lit("="), "i").alias("block"), "t"))
    looks = t.select("pos", F.coalesce(F.concat(F.lit("="), "i"), F.lit("*")).alias("block"), "t")
    pairs = similar_titles(looks.select("block", "t"), all_titles, threshold)
    name = lambda block, title: F.concat_ws("\n", F.lit("title"), block, title)
    follows = looks.join(pairs.withColumnRenamed("a", "t"), ["block", "t"]).select("pos", name(F.col("block"), F.col("b")).alias("block"), F.lit(False).alias("leads"))
    leads = t.select("pos", name(F.lit("*"), F.col("t")).alias("block"), F.lit(True).alias("leads")).unionByName(
        t.where("i is not null").select("pos", name(F.concat(F.lit("="), "i"), F.col("t")).alias("block"), F.lit(True).alias("leads"))
    )
    both = exact.unionByName(follows).unionByName(leads)
    return both.groupBy("pos", "block").agg(F.max("leads").alias("leads"))


def _final(base: DataFrame, firsts: DataFrame, alike: DataFrame, kept: DataFrame, threshold: float) -> DataFrame:
    """Each candidate's match in the catalog, by the first records of its keys and by title (alike), or among those kept; a
    kept candidate has none."""
    # places are of the catalog, which comes first, or of the candidates
    place = lambda kind, pos: F.struct(F.lit(kind).alias("kind"), pos.cast("long").alias("pos"))
    chosen = materialize(base.join(kept, "pos", "left_semi").withColumn("pos", place(1, F.col("pos"))))
    others = materialize(base.join(kept, "pos", "left_anti"))
    known = firsts.withColumn("existing", place(0, F.col("existing"))).unionByName(_firsts(chosen))
    exact = materialize(_best(_hits(others, known.groupBy("kind", "value").agg(F.min("existing").alias("existing"))).where(EARLIER)))
    titled = others.join(exact, "pos", "left_anti").join(alike, "pos", "left_anti")
    similar = alike.select("pos", place(0, F.col("existing")).alias("existing2"), "score").unionByName(
        ambiguous_matches(titled, chosen, threshold).where(EARLIER).withColumnRenamed("existing", "existing2")
    )
    joined = others.select("pos").join(exact, "pos", "left").join(similar, "pos", "left")
    found = F.coalesce("existing", "existing2")
    kind = F.col("found.kind")
    rest = joined.withColumn("found", found).select(
        "pos",
        F.when(F.col("existing").isNotNull(), "exact").otherwise("ambiguous").alias("match"),
        F.coalesce("by", F.lit("similitud de título")).alias("by"),
        F.when(kind == 0, "catalog").otherwise("candidate").alias("existing_kind"),
        F.col("found.pos").alias("existing"),
        F.when(F.col("existing").isNull(), F.col("score")).alias("score"),
    )
    none = kept.select("pos", F.lit("none").alias("match"), *[F.lit(None).cast(k).alias(n) for n, k in (("by", "string"), ("existing_kind", "string"), ("existing", "long"), ("score", "double"))])
    return rest.unionByName(none)


__all__ = ["ambiguous_matches", "classify", "exact_matches", "identity_keys", "similar_titles", "similarity"]
