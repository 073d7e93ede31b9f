"""Graph steps over edge tables: components, greedy matching, suppression, merging.

Greedy orders are run as rounds that give what the one-by-one order would: each round settles
what can't be changed by anything still open, and is cut in the shared folder, so a lost executor costs
a round at most. Chains of priorities are mostly local and settled by a few rounds. A long chain, such as a
row of boxes with one score, would take a round a box: what is open by then is gone through in order,
component by component, inside tasks of bounded size. Only components larger than that go on in rounds. There is no limit on rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rooftally.functions.session import cut, drop


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the smallest node (a whole number) that each node of ``edges`` can reach, itself included.

    Each round takes the smallest label next to a node, gives it to the node and to the node's own
    label, then takes the label that this label had. As whole trees are hooked, rounds grow with the
    logarithm of the longest path. Labels only fall, so a round that leaves their sum as it was is
    the last, and there always is one. Hot nodes are a join's skew, which Spark splits, and a
    minimum, which is taken before the shuffle. Nodes without
    an edge aren't in the result; no edges give an empty one.
    """
    one_way = edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()
    both = cut(one_way.select(F.explode(F.array(F.struct(F.col("x"), F.col("y")), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select("e.x", "e.y"))
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("low")).select("node", F.least("node", "low").alias("label")))
    total = F.sum(F.col("label").cast("decimal(38,0)"))
    last = labels.agg(total).first()[0]
    while last is not None:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("low"))
        found = labels.join(near, "node").select(F.explode(F.array(F.struct("node", "low"), F.struct(F.col("label").alias("node"), "low"))).alias("f"))
        low = found.groupBy("f.node").agg(F.min("f.low").alias("low"))
        hooked = labels.join(low, "node").select("node", F.least("label", "low").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = cut(hooked.join(jump, "label").select("node", F.least("label", "next").alias("label")), labels)
        now = labels.agg(total).first()[0]
        if now == last:
            break
        last = now
    drop(both)
    return labels


def components_inside(edges: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """`components` of edges that are mostly inside ``keys``: keys of up to FOLD edges are gone through in one pass, a key's edges in one task.

    If a key has more, or a node is met in several keys, rounds follow, in which each node of the small keys has one edge, to the smallest node that it reaches inside them.
    """
    n, number = len(keys), edges.select(F.least(a, b)).schema[0].dataType
    found = cut(edges.where(F.col(a) != F.col(b)).select(*keys, F.col(a).alias("a"), F.col(b).alias("b")).withColumn("_rank", F.lit(0)))
    small, large = _by_size(found, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, up, types = None, {}, []

        def top(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(up), types[0]), pa.array([top(x) for x in list(up)], types[0])], ["node", "label"])

        for batch in batches:
            types = [batch.schema[n].type]
            for group, x, y in _values(batch, n, n, n + 1):
                if group != now:
                    if up:
                        yield told()
                    now, up = group, {}
                x, y = top(up.setdefault(x, x)), top(up.setdefault(y, y))
                if x < y:
                    up[y] = x
                elif y < x:
                    up[x] = y
        if up:
            yield told()

    kind = number.simpleString()
    labels = cut(_in_order(small, keys, [*keys, "a", "b"], run, f"node {kind}, label {kind}"))
    apart = labels.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if large is None and apart:
        drop(found)
        return labels
    rest = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b")
    return components(rest if large is None else rest.unionByName(large.select("a", "b")), "a", "b")


def with_component(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """``nodes`` with ``component``, the smallest node that each can reach; a node without edges is its own. ``keys``: columns of ``edges`` that most paths stay inside."""
    labels = components(edges, a, b) if keys is None else components_inside(edges, keys, a, b)
    return nodes.join(labels.withColumnRenamed("node", node), node, "left").withColumn("component", F.coalesce("label", node)).drop("label")


def wide(number: Column, times: int, plus: Column | int) -> Column:
    """``number * times + plus`` as a number of 20 digits, which a long may not hold."""
    return (number.cast("decimal(20,0)") * times + plus).cast("decimal(20,0)")


def as_long(number: Column) -> Column:
    """A whole number as a long; one beyond it is told by its lowest 64 bits."""
    half, whole = (F.lit(str(2**n)).cast("decimal(20,0)") for n in (63, 64))
    return (F.pmod(number + half, whole) - half).cast("long")


#: Rounds of joins before the rest is folded component by component; edges of a component up to which one task folds it; edges of a group of such components.
ROUNDS, FOLD, GROUP = 5, 200_000, 20_000


def foldable(edges: DataFrame, u: Column, v: Column) -> tuple[DataFrame, DataFrame]:
    """``edges`` (ends ``u`` and ``v``, whole numbers) with ``_group``, for folding in order group by group; and those of components of over FOLD edges.

    A group holds whole components, so what happens in it depends on nothing else, and FOLD + about GROUP edges at most.
    """
    tagged = cut(edges.withColumns({"_u": u, "_v": v}))
    labels = components(tagged, "_u", "_v")
    tagged = cut(tagged.join(labels.select(F.col("node").alias("_u"), F.col("label").alias("_label")), "_u").drop("_u", "_v"))
    sizes = tagged.groupBy("_label").count()
    total = sizes.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    large = sizes.where(F.col("count") > FOLD).select("_label")
    group = F.pmod(F.xxhash64("_label"), F.lit(max(1, total // GROUP)))
    return tagged.join(large, "_label", "left_anti").withColumn("_group", group).drop("_label"), tagged.join(large, "_label", "left_semi").drop("_label")


def _end(side: str, keys: list[str], name: str) -> Column:
    """A node's number; two nodes with one number only make a component larger."""
    return F.xxhash64(F.lit(side), *keys, name)


def _by_size(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys of FOLD rows at most, which a task goes through in order, and those of others, None if there are none."""
    many = cut(df.groupBy(*keys).count().where(F.col("count") > FOLD).select(*keys))
    if many.isEmpty():
        return df, None
    return df.join(many, keys, "left_anti"), cut(df.join(many, keys, "left_semi"))


def _in_order(df: DataFrame, keys: list[str], columns: list[str], run, schema) -> DataFrame:
    """``run`` over Arrow batches of ``columns``, all rows of the same keys in one task by ``_rank``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, "_rank").select(*columns).mapInArrow(run, schema)


def _values(batch: pa.RecordBatch, keys: int, *more: int) -> Iterator[tuple]:
    """(keys, column, …) of each row."""
    return zip(zip(*[batch.column(k).to_pylist() for k in range(keys)]), *[batch.column(k).to_pylist() for k in more])


def greedy_match(edges: DataFrame, keys: list[str], a: str, b: str, order: list[Column]) -> DataFrame:
    """Edges that the greedy one-to-one matching takes, going through them by ``order`` (ascending; a total order inside keys).

    Keys of up to FOLD edges are gone through in order, all keys of a task in one pass over its sorted edges. For the others:
    an edge that comes first at both of its ends is taken whatever happens elsewhere; then its
    ends are gone. Repeating that takes the same edges as going one by one. What a few rounds leave is folded in order,
    a component in one task; rounds go on for components too large for one. Each round takes an edge at least.
    """
    left = cut(edges.withColumn("_rank", F.struct(*order)))
    small, large = _by_size(left, keys)
    n, columns = len(keys), [*keys, *[c for c in edges.columns if c not in keys]]
    ends = [columns.index(a), columns.index(b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used_a, used_b = None, set(), set()
        for batch in batches:
            won = []
            for i, (group, x, y) in enumerate(_values(batch, n, *ends)):
                if group != now:
                    now, used_a, used_b = group, set(), set()
                if x not in used_a and y not in used_b:
                    used_a.add(x)
                    used_b.add(y)
                    won.append(i)
            yield batch.take(pa.array(won, pa.int64()))

    taken = cut(_in_order(small, keys, columns, run, edges.select(*columns).schema).select(*edges.columns), left)
    return taken if large is None else taken.unionByName(_by_rounds(large, edges, keys, a, b))


def _by_rounds(left: DataFrame, edges: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    taken, left = _matched(left, keys, a, b, ROUNDS)
    if left is not None:
        small, large = foldable(left, _end("a", keys, a), _end("b", keys, b))
        at = [*keys, a], [*keys, b]

        def fold(pdf):
            pdf = pdf.loc[_ranked(pdf)]
            used_a, used_b, won = set(), set(), []
            for x, y in zip(pdf[at[0]].itertuples(index=False, name=None), pdf[at[1]].itertuples(index=False, name=None)):
                won.append(x not in used_a and y not in used_b)
                if won[-1]:
                    used_a.add(x)
                    used_b.add(y)
            return pdf.loc[won].drop(columns=["_rank", "_group"])

        taken = taken.unionByName(cut(small.groupBy("_group").applyInPandas(fold, edges.schema)))
        if not large.isEmpty():
            taken = taken.unionByName(_matched(cut(large), keys, a, b)[0])
    return taken


def _ranked(pdf):
    """The index of ``pdf`` by its column of structs ``_rank``."""
    ranks = [tuple(r.values()) for r in pdf["_rank"]]
    return pdf.index[sorted(range(len(ranks)), key=ranks.__getitem__)]


def _matched(left: DataFrame, keys: list[str], a: str, b: str, rounds: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(taken, what is open after so many rounds, None if nothing is)."""
    taken = None
    while rounds is None or rounds > 0:
        rounds = rounds if rounds is None else rounds - 1
        row = F.struct("_rank", *[c for c in left.columns if c not in (*keys, "_rank")])
        best_a = left.groupBy(*keys, a).agg(F.min(row).alias("m")).select(*keys, "m.*")
        best_b = left.groupBy(*keys, b).agg(F.min("_rank").alias("_rank"))
        won = cut(best_a.join(best_b, [*keys, b, "_rank"]).select(*left.columns))
        taken = won.drop("_rank") if taken is None else taken.unionByName(won.drop("_rank"))
        left = cut(left.join(won.select(*keys, a), [*keys, a], "left_anti").join(won.select(*keys, b), [*keys, b], "left_anti"), left)
        if left.isEmpty():
            return taken, None
    return taken, left


def priority_keep(nodes: DataFrame, conflicts: DataFrame, node: str, high: str, low: str, order: list[Column]) -> DataFrame:
    """Nodes that greedy suppression keeps. ``conflicts``: pairs, where high comes before low by ``order`` (ascending, of high; total).

    A node goes if a node that stays comes before it; it stays once all before it are gone. Rounds, then folds, as in `greedy_match`.
    """
    edges = cut(conflicts.select(F.col(high).alias("_h"), F.col(low).alias("_l"), F.struct(*order).alias("_rank")).dropDuplicates(["_h", "_l"]))
    gone, edges = _suppressed(edges, ROUNDS)
    if edges is not None:
        small, large = foldable(edges, F.col("_h"), F.col("_l"))

        def fold(pdf):
            pdf = pdf.loc[_ranked(pdf)]
            out = set()
            for h, x in zip(pdf["_h"], pdf["_l"]):
                if h not in out:
                    out.add(x)
            return pdf[["_l"]].drop_duplicates().loc[lambda d: d["_l"].isin(out)].rename(columns={"_l": "_n"})

        gone = gone.unionByName(cut(small.groupBy("_group").applyInPandas(fold, gone.schema)))
        if not large.isEmpty():
            gone = gone.unionByName(_suppressed(cut(large))[0])
    return nodes.join(gone.withColumnRenamed("_n", node), node, "left_anti")


def _suppressed(edges: DataFrame, rounds: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    gone = edges.select(F.col("_l").alias("_n")).limit(0)
    while rounds is None or rounds > 0:
        rounds = rounds if rounds is None else rounds - 1
        first = edges.select("_h").distinct().join(edges.select(F.col("_l").alias("_h")), "_h", "left_anti")
        out = cut(edges.join(first, "_h", "left_semi").select(F.col("_l").alias("_n")).distinct())
        gone = gone.unionByName(out)
        edges = cut(edges.join(out.withColumnRenamed("_n", "_h"), "_h", "left_anti").join(out.withColumnRenamed("_n", "_l"), "_l", "left_anti"), edges)
        if edges.isEmpty():
            return gone, None
    return gone, edges


def merge_match(cover: DataFrame, members: DataFrame, keys: list[str], gt: str, pred: str, order: list[Column]) -> DataFrame:
    """Ground truth that the many-to-one matching accepts. cover: a row per candidate; members: its predictions.

    By ``order`` (ascending), a candidate is accepted if one of its predictions is free, and then takes all
    of them. Keys of up to FOLD links are gone through in order, as in `greedy_match`; in the others a candidate is settled once all before it that share a prediction are: rounds, then folds.
    """
    ranked = cut(cover.withColumn("_rank", F.struct(*order)))
    links = cut(members.select(*keys, gt, pred).join(ranked.select(*keys, gt, "_rank"), [*keys, gt]))
    small, large = _by_size(links, keys)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, now, used, own, won, names, types = None, None, set(), set(), [], [], []

        def settle() -> None:
            if own - used:
                won.append((*who[0], who[1]))
                used.update(own)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*won), types)] if won else [pa.array([], t) for t in types], names)

        for batch in batches:
            names, types = batch.schema.names[: n + 1], [f.type for f in batch.schema][: n + 1]
            for group, x, y in _values(batch, n, n, n + 1):
                if (group, x) != who:
                    settle()
                    if group != now:
                        now, used = group, set()
                    who, own = (group, x), set()
                own.add(y)
            yield told()
            won = []
        settle()
        if won:
            yield told()

    accepted = cut(_in_order(small, keys, [*keys, gt, pred], run, links.select(*keys, gt).schema))
    if large is not None:
        accepted = accepted.unionByName(_merged_by_rounds(large, keys, gt, pred))
    drop(links)
    return ranked.join(accepted, [*keys, gt], "left_semi").drop("_rank")


def _merged_by_rounds(links: DataFrame, keys: list[str], gt: str, pred: str) -> DataFrame:
    accepted, taken, links = _merged(links, keys, gt, pred, ROUNDS)
    if links is not None:
        free = links.join(taken.withColumn("_taken", F.lit(True)), [*keys, pred], "left").withColumn("_taken", F.coalesce("_taken", F.lit(False)))
        small, large = foldable(free, _end("a", keys, gt), _end("b", keys, pred))

        def fold(pdf):
            pdf = pdf.loc[_ranked(pdf)]
            used = {p for p, t in zip(pdf[[*keys, pred]].itertuples(index=False, name=None), pdf["_taken"]) if t}
            won = []
            for who, rows in pdf.groupby([*keys, gt], sort=False):
                own = set(rows[[*keys, pred]].itertuples(index=False, name=None))
                if own - used:
                    won.append(who)
                    used |= own
            return pdf[[*keys, gt]].drop_duplicates().loc[lambda d: [x in set(won) for x in d.itertuples(index=False, name=None)]]

        accepted = accepted.unionByName(cut(small.groupBy("_group").applyInPandas(fold, accepted.schema)))
        if not large.isEmpty():
            accepted = accepted.unionByName(_merged(cut(large.drop("_taken")), keys, gt, pred, taken=taken)[0])
    return accepted


def _merged(links: DataFrame, keys: list[str], gt: str, pred: str, rounds: int | None = None, taken: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    accepted = links.select(*keys, gt).limit(0)
    taken = links.select(*keys, pred).limit(0) if taken is None else taken
    while rounds is None or rounds > 0:
        rounds = rounds if rounds is None else rounds - 1
        first = links.groupBy(*keys, pred).agg(F.min("_rank").alias("_first"))
        ready = links.join(first, [*keys, pred]).groupBy(*keys, gt).agg(F.every(F.col("_rank") == F.col("_first")).alias("ready")).where("ready").drop("ready")
        now = cut(links.join(ready, [*keys, gt], "left_semi"))
        won = cut(now.join(taken, [*keys, pred], "left_anti").select(*keys, gt).distinct())
        accepted = accepted.unionByName(won)
        taken = cut(taken.unionByName(now.join(won, [*keys, gt], "left_semi").select(*keys, pred)).distinct())
        links = cut(links.join(now.select(*keys, gt).distinct(), [*keys, gt], "left_anti"), links)
        drop(now)
        if links.isEmpty():
            return accepted, taken, None
    return accepted, taken, links
