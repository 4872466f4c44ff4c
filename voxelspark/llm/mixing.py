"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone.

A source's target is the share of its weight in the mix, at most ``cap`` times its size; what is cut off goes
to the others by weight until none is above. A document of a source whose target is f times its size is due f
copies: floor(f) surely and one more with probability p = f - floor(f). Which ones get it is settled by the
pivotal method: of two fractional documents one gains probability and the other loses it, in proportion to
their sizes so that the words due stay what they are, and by a draw that leaves each expectation alone; one of
them becomes integral. A source's documents are dealt by hash into groups of about ``FAN``; each group is
folded until one fractional document is left, and those are dealt and folded again: a tree of log(n)/log(FAN)
levels in which no task holds a source. The one left at the root is rounded to the nearest, so a source's
words miss its target by half a document at most.

Rows of equal source, id and size are counted first and told apart by a number, so that null or repeated ids are
dealt like any others. Draws are hashes of ids, sizes and these numbers, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
FAN = 64
#: Rows that are alike are numbered in runs of this many.
RUN = 4096
SEED = 17

_WORD = r"[^\\x20\\x09-\\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, n, rank, target) from (source, size, copies_of). Sources by code point, null last, take the weights in turn.

    The windows run over one row per source.
    """
    src = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies_of")).alias("source_size"), F.sum("copies_of").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    src = src.withColumn("rank", rank)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    src = src.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(cap))
    every = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    whole = Window.partitionBy(F.lit(0))
    src = src.withColumn("total", F.lit(share) * F.sum("source_size").over(whole)).withColumn("all_w", F.sum("w").over(whole))
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    src = src.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    # below the first source that is under its cap, all are at their caps; from it on, its level holds
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "rank", "level"))).over(whole)["level"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("w")))
    return src.withColumn("target", target).select("source", "source_size", "n", "rank", "target")


def _fold(level: int) -> str:
    """SQL that folds the array g of (u, doc_id, size, extra, p) to (carry, done)."""
    item = "struct<u:bigint,doc_id:bigint,size:bigint,p:double>"
    draw = f"(pmod(xxhash64(c.doc_id, c.u, x.doc_id, x.u, {level}, {SEED}), 4503599627370496) + 0.5D) / 4503599627370496D"
    step = f"""
      transform(array(named_struct('c', acc.carry, 'x', x)), t -> transform(array(named_struct('c', t.c, 'x', t.x,
        'a', least(1D - t.c.p, t.x.p * t.x.size / t.c.size), 'b', least(t.c.p, (1D - t.x.p) * t.x.size / t.c.size), 'r', {draw.replace("c.", "t.c.").replace("x.", "t.x.")})),
        m -> transform(array(if(m.r * (m.a + m.b) < m.b,
          named_struct('cp', if(1D - m.c.p <= m.x.p * m.x.size / m.c.size, 1D, m.c.p + m.a), 'xp', if(m.x.p * m.x.size / m.c.size <= 1D - m.c.p, 0D, m.x.p - m.a * m.c.size / m.x.size), 'm', m),
          named_struct('cp', if(m.c.p <= (1D - m.x.p) * m.x.size / m.c.size, 0D, m.c.p - m.b), 'xp', if((1D - m.x.p) * m.x.size / m.c.size <= m.c.p, 1D, m.x.p + m.b * m.c.size / m.x.size), 'm', m))),
          q -> transform(array(named_struct(
            'c', named_struct('u', q.m.c.u, 'doc_id', q.m.c.doc_id, 'size', q.m.c.size, 'p', q.cp),
            'x', named_struct('u', q.m.x.u, 'doc_id', q.m.x.doc_id, 'size', q.m.x.size, 'p', q.xp))),
            e -> named_struct(
              'carry', if(e.c.p > 0D and e.c.p < 1D, e.c, if(e.x.p > 0D and e.x.p < 1D, e.x, cast(null as {item}))),
              'done', concat(acc.done, filter(array(e.c, e.x), y -> y.p <= 0D or y.p >= 1D))))[0])[0])[0])[0]"""
    start = f"cast(named_struct('carry', null, 'done', array()) as struct<carry:{item},done:array<{item}>>)"
    return f"aggregate(g, {start}, (acc, x) -> if(acc.carry is null, named_struct('carry', x, 'done', acc.done), {step}))"


def _numbered(alike: DataFrame) -> DataFrame:
    """A row for each of the ``copies_of`` rows that are alike, with a number ``at``; runs of them are dealt before they are spelled out."""
    last = F.col("copies_of") - 1
    runs = alike.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / RUN))))
    few, many = runs.where(f"copies_of <= {RUN}"), runs.where(f"copies_of > {RUN}").repartition("doc_id", "size", "run")
    first = F.col("run") * RUN
    return few.unionByName(many).withColumn("at", F.explode(F.sequence(first, F.least(last, first + (RUN - 1))))).drop("run", "copies_of")


def mixture(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, copies.

    size is the number of words cut at white space, 0 for a null text; a document of size 0 is taken 0 times.
    A null source is a source. Rows that repeat an id are documents of their own. Other columns are not read.
    """
    size = F.coalesce(F.expr(f"regexp_count(text, '{_WORD}')"), F.lit(0)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"))
    sized = cut(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies_of")))
    targets = cut(source_targets(sized, weights, share, cap))
    most = targets.agg(F.max("n")).first()[0] or 0
    t = targets.withColumnRenamed("source", "of")
    due = sized.join(t, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    due = due.withColumn("sure", F.when(F.col("size") > 0, F.floor(f)).otherwise(0)).withColumn("p", F.when(F.col("size") > 0, f - F.floor(f)).otherwise(0.0))
    due = _numbered(due.select("doc_id", "size", "copies_of", "rank", "n", "p"))
    settled = due.where("p <= 0").select("doc_id", "size", "rank")
    rest = due.where("p > 0").select("rank", "n", F.xxhash64("doc_id", "size", "at", F.lit(SEED)).alias("u"), "doc_id", "size", "p")
    outs, level, groups = [], 0, most
    while True:
        last = groups <= FAN
        of = F.ceil(F.col("n") / F.lit(FAN ** (level + 1)))
        dealt = rest.withColumn("g_no", F.pmod(F.xxhash64("u", "doc_id", F.lit(level)), of))
        grouped = dealt.groupBy("rank", "g_no").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("u", "doc_id", "size", "p"))).alias("g"))
        folded = cut(grouped.select("rank", "n", F.expr(_fold(level)).alias("f")))
        outs.append(folded.select("rank", F.explode("f.done").alias("d")))
        rest = folded.where("f.carry is not null").select("rank", "n", "f.carry.*")
        if last:
            break
        groups, level = -(-groups // FAN), level + 1
    outs.append(rest.select("rank", F.struct("u", "doc_id", "size", F.round("p").alias("p")).alias("d")))
    decided = outs[0]
    for o in outs[1:]:
        decided = decided.unionByName(o)
    by_rank = targets.select("rank", "source_size", "target", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("sure"))
    decided = decided.select("rank", "d.doc_id", "d.size", F.col("d.p").cast("long").alias("more"))
    decided = decided.unionByName(settled.select("rank", "doc_id", "size", F.lit(None).cast("long").alias("more")))
    out = decided.join(by_rank, "rank")
    copies = F.when(F.col("size") > 0, F.col("sure") + F.coalesce("more", F.lit(0))).otherwise(0).cast("long")
    return out.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
