"""Balanced label propagation: linked documents move together, shards stay even.

Links are hyperedges: documents that share a link key are all linked, as if through
a hub, so a key of very many documents costs a row each and never pairs.

Hubs of more than a quarter of a shard are few.  They are placed first, the largest
first: whole where one fits, or else over as few shards as have room for it.  Then in
each round every other hub's documents want to go to the open shard that holds most of
them.  A shard takes newcomers up to its room, its share less what is placed there and
the linked documents that do not ask to leave, and takes a hub's documents together or
not at all.  A shard that had to refuse some is closed, and those look for the
next best.  So after at most a round per shard all hubs are together, or no shard has
room for the rest.  Last, documents without links fill the shards up so that the counts
differ by one at most; linked ones move only if those do not suffice.

Ranks and rooms are worked out on counts per cell (shard and hash range), of which
there is a fixed number; only cells on a boundary are sorted.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.llm.shared import written

#: Hash cells per shard.
CELLS = 256


def _cell(*what: Column | str) -> Column:
    return F.pmod(F.xxhash64(F.lit("cell"), *what), F.lit(CELLS)).cast("int")


def _counts(df: DataFrame, *keys: str) -> dict:
    """Rows per key tuple; keys are shards and cells, so the result has a fixed bound."""
    return {tuple(r[k] for k in keys): r["n"] for r in df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()}


def _goal(shards: int, total: int) -> dict[int, int]:
    return {s: total // shards + (s < total % shards) for s in range(shards)}


def _places(large: list[tuple], room: dict[int, int]) -> list[tuple]:
    """(number, low, high, shard) for parts of the `large` hubs (hub, n); what they take is taken from `room`."""
    plan = []
    for number, (_, n) in enumerate(large):
        at = 0
        while at < n:
            # The least room that takes all of it, or else the most.
            fits = [s for s in room if room[s] >= n - at]
            shard = min(fits, key=lambda s: (room[s], s)) if fits else max(room, key=lambda s: (room[s], -s))
            take = min(room[shard], n - at)
            plan.append((number, at, at + take, shard))
            room[shard] -= take
            at += take
    return plan


def _start(room: dict[int, int]) -> Column:
    """A hashed shard for each row, so that shards begin with rows in proportion to their room."""
    bounds = list(accumulate(room[s] for s in sorted(room)))
    at = F.pmod(F.xxhash64(F.lit("start"), "row"), F.lit(max(1, bounds[-1])))
    before = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= at))
    return F.least(before, F.lit(len(room) - 1)).cast("int")


def _placed(state: DataFrame, large: list[tuple], plan: list[tuple]) -> DataFrame:
    """The rows of the `large` hubs with their shards by the plan."""
    spark = state.sparkSession
    hubs = F.broadcast(spark.createDataFrame([(hub, k) for k, (hub, _) in enumerate(large)], "hub long, large int"))
    plan = F.broadcast(spark.createDataFrame(plan, "of int, low long, high long, to int"))
    rows = _ranked(state.filter("linked").join(hubs, "hub").withColumn("cell", _cell("row")), "large")
    rows = rows.join(plan, (F.col("large") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return rows.withColumn("shard", F.col("to")).select(*state.columns)


def _votes(linked: DataFrame, closed: set[int], shards: int) -> DataFrame:
    """hub, wanted: the open shard with most of the hub's documents, ties to a hashed order.

    A hub that is together stays; one in closed shards only wants a hashed open one.
    """
    is_open = sorted(set(range(shards)) - closed)
    held = linked.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    votes = F.when(F.col("shard").isin(is_open), F.struct("n", F.xxhash64("hub", "shard")))
    best = held.groupBy("hub").agg(F.max_by("shard", votes).alias("best"), F.count(F.lit(1)).alias("parts"), F.first("shard").alias("only"))
    other = F.lit(None).cast("int")
    if is_open:
        other = F.get(F.array(*map(F.lit, is_open)), F.pmod(F.xxhash64(F.lit("other"), "hub"), F.lit(len(is_open))).cast("int"))
    return best.select("hub", F.when(F.col("parts") == 1, F.col("only")).otherwise(F.coalesce("best", other)).alias("wanted"))


def _move(state: DataFrame, room: dict[int, int], closed: set[int]) -> tuple[DataFrame, set[int]]:
    """One round: hubs' documents move to the wanted shard as far as there is room; also the shards that refused some."""
    wants = state.join(_votes(state.filter("linked").select("hub", "shard"), closed, len(room)), "hub", "left")
    # Rows without links have hubs of their own, so that no join gathers them under null.
    asking = F.col("linked") & F.col("wanted").isNotNull() & (F.col("wanted") != F.col("shard"))
    wants = wants.withColumn("asks", asking).withColumn("hub_cell", _cell("hub")).withColumn("sub_cell", _cell(F.lit("sub"), "hub"))
    stays = _counts(wants.filter(F.col("linked") & ~F.col("asks")), "shard")
    asked = _counts(wants.filter("asks"), "wanted", "hub_cell")
    taken, edges, left = [], {}, {s: room[s] - stays.get((s,), 0) for s in room}
    for (shard, cell), n in sorted(asked.items(), key=lambda found: (found[1], found[0])):
        if n <= left[shard]:
            taken.append((shard, cell, -1))
            left[shard] -= n
        else:  # the first that does not fit is looked at more closely
            edges.setdefault(shard, cell)
    if edges:
        edge = F.expr(" OR ".join(f"(wanted = {s} AND hub_cell = {c})" for s, c in edges.items()))
        inside = _counts(wants.filter(F.col("asks") & edge), "wanted", "hub_cell", "sub_cell")
        for key, n in sorted(inside.items(), key=lambda found: (found[1], found[0])):
            if n <= left[key[0]]:
                taken.append(key)
                left[key[0]] -= n
    if not taken:
        return state, set(edges)
    plan = F.broadcast(state.sparkSession.createDataFrame(taken, "wanted int, hub_cell int, sub int"))
    whole = plan.filter("sub = -1").select("wanted", "hub_cell", F.lit(True).alias("all"))
    part = plan.filter("sub >= 0").select("wanted", "hub_cell", F.col("sub").alias("sub_cell"), F.lit(True).alias("some"))
    moved = wants.join(F.broadcast(whole), ["wanted", "hub_cell"], "left").join(F.broadcast(part), ["wanted", "hub_cell", "sub_cell"], "left")
    goes = F.col("asks") & F.coalesce("all", "some", F.lit(False))
    return moved.withColumn("shard", F.when(goes, F.col("wanted")).otherwise(F.col("shard"))).select(*state.columns), set(edges)


def _ranked(df: DataFrame, *groups: str) -> DataFrame:
    """`rank` from 0 inside each group, without gaps: offsets of cells and a row number inside each cell."""
    cells = {}
    found = _counts(df, *groups, "cell")
    for key in sorted(found):
        cells.setdefault(key[:-1], []).append((key[-1], found[key]))
    offsets = [
        (*group, cell, before)
        for group, items in cells.items()
        for (cell, _), before in zip(items, accumulate((n for _, n in items), initial=0), strict=False)
    ]
    names = [*groups, "cell"]
    schema = ", ".join(f"{n} int" for n in names) + ", offset long"
    offsets = F.broadcast(df.sparkSession.createDataFrame(offsets, schema))
    inside = Window.partitionBy(*names).orderBy("row")
    return df.withColumn("inside", F.row_number().over(inside) - 1).join(offsets, names, "left").withColumn("rank", F.col("offset") + F.col("inside")).drop("inside", "offset")


def _even(state: DataFrame, shards: int, total: int) -> DataFrame:
    """Move what a shard has beyond its count to shards that lack some; unlinked documents first."""
    goal = _goal(shards, total)
    load = _counts(state, "shard")
    excess = {s: load.get((s,), 0) - goal[s] for s in range(shards)}
    celled = state.withColumn("cell", _cell("row") + F.when(F.col("linked"), CELLS).otherwise(0))
    found, last, places = _counts(celled, "shard", "cell"), [], []
    for s in range(shards):
        left = max(0, excess[s])
        for cell in range(2 * CELLS):
            n = found.get((s, cell), 0)
            if left <= 0:
                last.append((s, cell, 0))
                break
            if n >= left:
                last.append((s, cell, left))
                break
            left -= n
        else:
            last.append((s, 2 * CELLS, 0))
    spark = state.sparkSession
    edge = F.broadcast(spark.createDataFrame(last, "shard int, edge int, take int"))
    marked = celled.join(edge, "shard")
    on_edge = marked.filter(F.col("cell") == F.col("edge")).withColumn("r", F.row_number().over(Window.partitionBy("shard").orderBy("row")))
    leaving = marked.filter(F.col("cell") < F.col("edge")).unionByName(on_edge.filter(F.col("r") <= F.col("take")).drop("r"))
    leaving = _ranked(leaving.select("row", "shard", _cell("row").alias("cell")).withColumn("shard", F.col("shard").cast("int")), "shard")
    starts = dict(zip(range(shards), accumulate((max(0, excess[s]) for s in range(shards)), initial=0), strict=False))
    at = 0
    for s in range(shards):
        if excess[s] < 0:
            places.append((s, at, at - excess[s]))
            at -= excess[s]
    first = F.create_map(*(F.lit(x) for pair in starts.items() for x in pair))
    leaving = leaving.select("row", (first[F.col("shard")] + F.col("rank")).alias("place"))
    goes = F.lit(None).cast("int")
    for s, a, b in places:
        goes = F.when((F.col("place") >= a) & (F.col("place") < b), s).otherwise(goes)
    moved = state.join(leaving.select("row", goes.alias("to")), "row", "left")
    return moved.withColumn("shard", F.coalesce("to", "shard")).drop("to")


def assign(rows: DataFrame, shards: int) -> DataFrame:
    """Shard and slot of every row of (row, hub): row, shard, slot.

    `row` is unique; rows with an equal hub that is not null are linked.  Counts
    of the shards differ by at most one, and slots number the rows of a shard
    from 0 without gaps.  An empty table gives an empty result.
    """
    total = rows.count()
    sizes = rows.filter(F.col("hub").isNotNull()).groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    room, linked = _goal(shards, total), sizes.select("hub", (F.col("n") > 1).alias("linked"))
    # Fewer than eight for a shard, as their sizes say.
    large = sizes.filter(F.col("n") > max(1, total // shards // 4)).select("hub", "n").collect()
    large = sorted(((r["hub"], r["n"]) for r in large), key=lambda hub: (-hub[1], hub[0]))
    plan = _places(large, room)
    state = rows.join(linked, "hub", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    state = state.withColumn("hub", F.when(F.col("linked"), F.col("hub")).otherwise(F.xxhash64("row"))).withColumn("shard", _start(room))
    state = written(state, "shards-start")
    placed = None
    if large:
        placed = written(_placed(state, large, plan), "shards-large")
        state = state.join(F.broadcast(placed.select("hub").dropDuplicates()), "hub", "left_anti")
    closed: set[int] = set()
    while len(closed) < shards:
        state, refused = _move(state, room, closed)
        state = written(state, f"shards-{len(closed)}")
        if not refused:
            break
        closed |= refused
    state = state if placed is None else state.unionByName(placed)
    state = written(_even(state, shards, total), "shards-even").withColumn("cell", _cell("row"))
    return _ranked(state, "shard").select("row", "shard", F.col("rank").cast("long").alias("slot"))


def cut_links(rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row: links (documents that share a hub with another) and those away from their hub's largest part."""
    held = rows.filter(F.col("hub").isNotNull()).join(assigned, "row").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    hubs = held.groupBy("hub").agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter("n > 1")
    return hubs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("linked"), F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0)).alias("cut"))


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every document with its shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Documents of equal text are linked.  The law is `rows`.  A null text has size
    1 and no link, its checksum is null; an empty text links like any other.  Rows
    that repeat a doc_id, null ones among them, each get a place of their own.
    """
    text = F.col("text")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("hub"),
    )
    # Rows that repeat a doc_id and text are told apart by a number; which is which makes no difference.
    twin = F.row_number().over(Window.partitionBy("doc_id", "hub", "text_crc32").orderBy("size"))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "hub", twin)
    numbered = written(base.withColumn("row", name), "shards-rows")
    found = assign(numbered.select("row", "hub"), shards)
    return numbered.join(found, "row").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
