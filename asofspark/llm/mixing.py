"""Operator 7: mixing sources to target weights by min-cost flow.

Sources overlap where they hold equal texts.  Texts are aggregated by membership pattern (the
set of sources that hold them): a pattern can send the words of its distinct texts once at no
cost, and again at rising cost for every repetition; what it sends to a source comes from
the copies that this source holds, each MAX_EPOCHS times at most.  A min-cost flow over these
few nodes meets every source's quota with the least repetition, so a source takes what only
it holds before what others can use too.  Whole documents are then selected in a seeded
order, with the odds that the flow gives their pattern, until their source's words are met.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofspark.llm.storage import stored

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
WORDS = r"[^\x20\x09-\x0D]+"
#: Patterns of several sources whose sharing is weighed; of any more, those with fewest words, each source uses its own copies.
MAX_PATTERNS = 20_000
#: Sources at most (an error beyond it: the driver holds one number for each).
MAX_SOURCES = 100_000
#: Rows of the cells' table up to which it is broadcast.
SMALL_TABLE = 50_000
#: Keys that a text with copies in several sources is dealt over.
SALTS = 16
#: A source's documents are summed by digits of their seeded place: LEVELS times 16^DIGITS cells, each level in one cell of the last.
DIGITS, LEVELS = 2, 4
#: Documents added to a source after the seeded order, each the best fit for what is left.
FILLS = 3
_EPS = 1e-6


def quotas(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS, ceiling: float = MAX_EPOCHS, total: float | None = None) -> dict[str | None, float]:
    """Target words of each source.

    Sources in code-point order, null last, get the weights in turn and share ``total`` (the
    sum of all sizes unless given); a target stops at ``ceiling`` times its source's size, and what exceeds it is
    shared again by weight among the others until none is above.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: float(weights[k % len(weights)]) for k, (s, _) in enumerate(order)}
    size, left, target = dict(order), float(sum(n for _, n in order) if total is None else total), {}
    free = [s for s, _ in order]
    while free:
        share = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / share > ceiling * size[s]]
        if not above:
            target |= {s: left * weight[s] / share for s in free}
            break
        target |= {s: float(ceiling * size[s]) for s in above}
        left -= sum(target[s] for s in above)
        free = [s for s in free if s not in target]
    return {s: target[s] for s, _ in order}


def _layers(words: float, most: float) -> list[float]:
    """Capacities at cost 0, 1, 2, ...: the words of a pattern four times one by one, then twice as much at each cost."""
    out, width = [], words
    while most > _EPS and words > 0:
        if len(out) > 3:
            width *= 2
        out.append(min(width, most))
        most -= out[-1]
    return out


def min_cost_flow(patterns: Sequence[tuple[float, Mapping]], quota: Mapping, epochs: int = MAX_EPOCHS) -> list[dict]:
    """Words that each pattern (words of its distinct texts, and for each source those of its copies) sends to each source.

    The costs stand only on the arcs into patterns, and all layers of a pattern cost the
    same as those of any other; so raising the flow cost by cost, each time to its maximum
    (blocking flows in layered residual graphs), gives the cheapest one.
    """
    names = list(quota)
    place = {s: k for k, s in enumerate(names)}
    need = [float(quota[s]) for s in names]
    of_pattern: list[list[int]] = [[] for _ in patterns]
    of_source: list[list[int]] = [[] for _ in names]
    tail, head, room, flow = [], [], [], []
    for p, (_, copies) in enumerate(patterns):
        for s, held in copies.items():
            if s in place and held > 0:
                of_pattern[p].append(len(tail))
                of_source[place[s]].append(len(tail))
                tail.append(p)
                head.append(place[s])
                room.append(float(epochs * held))
                flow.append(0.0)
    layers = [_layers(float(w), float(epochs * sum(c.values()))) for w, c in patterns]
    left = [0.0] * len(patterns)

    def phase() -> bool:
        """One blocking flow; False if no quota can be raised."""
        depth_p = [0 if v > _EPS else -1 for v in left]
        depth_s = [-1] * len(names)
        queue = deque((p, True) for p, d in enumerate(depth_p) if d == 0)
        end = None
        while queue:
            at, is_pattern = queue.popleft()
            if is_pattern:
                if end is not None and depth_p[at] >= end:
                    break
                for a in of_pattern[at]:
                    if room[a] > _EPS and depth_s[head[a]] < 0:
                        depth_s[head[a]] = depth_p[at] + 1
                        if need[head[a]] > _EPS:
                            end = depth_p[at] + 1 if end is None else end
                        queue.append((head[a], False))
            elif end is None:
                for a in of_source[at]:
                    if flow[a] > _EPS and depth_p[tail[a]] < 0:
                        depth_p[tail[a]] = depth_s[at] + 1
                        queue.append((tail[a], True))
        if end is None:
            return False
        next_p, next_s = [0] * len(patterns), [0] * len(names)
        for first in range(len(patterns)):
            while left[first] > _EPS:
                path, at, is_pattern = [], first, True
                while True:
                    if is_pattern:
                        arcs, k = of_pattern[at], next_p[at]
                        while k < len(arcs) and not (room[arcs[k]] > _EPS and depth_s[head[arcs[k]]] == depth_p[at] + 1):
                            k += 1
                        next_p[at] = k
                    else:
                        if need[at] > _EPS and depth_s[at] == end:
                            break
                        arcs, k = of_source[at], next_s[at]
                        while k < len(arcs) and not (depth_s[at] < end and flow[arcs[k]] > _EPS and depth_p[tail[arcs[k]]] == depth_s[at] + 1):
                            k += 1
                        next_s[at] = k
                    if k < len(arcs):
                        path.append((arcs[k], is_pattern))
                        at, is_pattern = (head if is_pattern else tail)[arcs[k]], not is_pattern
                    elif path:
                        a, forward = path.pop()
                        at, is_pattern = (tail[a], True) if forward else (head[a], False)
                        (next_p if is_pattern else next_s)[at] += 1
                    else:
                        break
                if not path:
                    break
                sent = min(left[first], need[at], *(room[a] if forward else flow[a] for a, forward in path))
                left[first] -= sent
                need[at] -= sent
                for a, forward in path:
                    flow[a] += sent if forward else -sent
                    room[a] += -sent if forward else sent
        return True

    for cost in range(max(map(len, layers), default=0)):
        for p, known in enumerate(layers):
            left[p] += known[cost] if cost < len(known) else 0.0
        while phase():
            pass
        if max(need, default=0.0) <= _EPS:
            break
    return [{names[head[a]]: flow[a] for a in arcs} for arcs in of_pattern]


def with_sizes(docs: DataFrame, text: str = "text", source: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, _key (digest of a text with words), _tag (the source, null told apart), _size (words; null text: 0), _salt."""
    own = [F.col(c).alias(f"_kept{i}") for i, c in enumerate(keep)]
    size = F.coalesce(F.regexp_count("_text", F.lit(WORDS)), F.lit(0)).cast("long")
    tag = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    rows = docs.select(*own, F.col("doc_id").cast("string").alias("_id"), tag.alias("_tag"), F.col(text).alias("_text")).withColumn("_size", size)
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce("_id", F.lit(""))))
    return rows.select(*[f"_kept{i}" for i in range(len(keep))], F.when(F.col("_size") > 0, F.md5("_text")).alias("_key"), "_tag", "_size", digest.alias("_digest")).withColumn(
        "_salt", F.pmod(F.xxhash64("_digest"), F.lit(SALTS)).cast("int")
    )


def _single(tag: Column) -> Column:
    return F.to_json(F.array(tag))


def _texts(rows: DataFrame) -> DataFrame:
    """_key, members (tags of the sources that hold it) and words of each distinct text."""
    return rows.where("_key is not null").groupBy("_key").agg(F.array_sort(F.collect_set("_tag")).alias("members"), F.first("_size").alias("words"))


def _patterned(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Adds _pattern: the members of a shared text, else the row's own source.  A text with many copies is dealt over SALTS keys."""
    dealt = shared.select("_key", F.to_json("members").alias("_pattern"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return rows.join(dealt, ["_key", "_salt"], "left").withColumn("_pattern", F.coalesce("_pattern", _single(F.col("_tag"))))


def _placed(rows: DataFrame, cells: DataFrame, small: bool) -> DataFrame:
    """Adds _full (times that the row is taken whole in any case) and _place, its seeded place among its source's rows.

    A place is a number that is uniform in the document, divided by the odds of the row's cell:
    in the order of places every cell is taken at the same pace.  Rows that can't be
    taken again have none; rows of no odds stand behind all others.
    """
    known = F.broadcast(cells) if small else cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.join(known, ["_pattern", "_tag"] if small else ["_pattern", "_tag", "_salt"])
    pace = F.conv(F.substring("_digest", 1, 13), 16, 10).cast("double") / F.lit(2.0**52) / F.col("_odds")
    scaled = F.lpad(F.hex((pace / (pace + 1) * F.lit(2.0**52)).cast("long")), 13, "0")
    place = F.concat(F.when(F.col("_odds") > 0, scaled).otherwise(F.lit("G")), F.upper(F.substring("_digest", 1, 16)))
    return joined.withColumn("_place", F.when(F.col("_full") < MAX_EPOCHS, place))


def plan(rows: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame, DataFrame, bool, DataFrame]:
    """What the mix takes of the rows of with_sizes(): these with their pattern, shared texts, cells, whether the cells are few, and the sources' table.

    A cell is a pattern and one of its sources: _full and _odds of its rows.  The sources'
    table has _tag, source_size, target, and the places of the documents that are taken
    once more (up to ``cut``, and ``fills``).
    """
    spark = rows.sparkSession
    texts = stored(_texts(rows))
    shared = texts.where(F.size("members") > 1)
    totals = shared.groupBy("members").agg(F.sum("words").alias("w"))
    if totals.count() > MAX_PATTERNS:
        largest = totals.orderBy(F.desc("w"), "members").limit(MAX_PATTERNS).select("members")
        shared = stored(shared.join(largest, "members", "left_semi"))
    whole = shared.select(F.to_json("members").alias("_pattern"), "words")
    # A text that is weighed alone has its words in every source that holds it.
    apart = texts.join(shared.select("_key"), "_key", "left_anti").select(F.explode("members").alias("_tag"), "words").select(_single(F.col("_tag")).alias("_pattern"), "words")
    distinct = dict(map(tuple, whole.unionByName(apart).groupBy("_pattern").agg(F.sum("words")).limit(MAX_PATTERNS + MAX_SOURCES + 1).collect()))
    rows = stored(_patterned(rows, shared))
    held = rows.groupBy("_pattern", "_tag").agg(F.sum("_size").alias("n")).collect()  # a row for each member of the patterns above
    size: dict[str, int] = {}
    copies: dict[str, dict[str, int]] = {}
    for r in sorted(held):
        size[r["_tag"]] = size.get(r["_tag"], 0) + r["n"]
        copies.setdefault(r["_pattern"], {})[r["_tag"]] = r["n"]
    if len(size) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plain = lambda tag: None if tag == "null" else tag[1:]
    goal = {("null" if s is None else f"={s}"): t for s, t in quotas([(plain(t), n) for t, n in size.items()], weights, epochs).items()}
    order = sorted(copies)
    flows = min_cost_flow([(distinct.get(p, 0), copies[p]) for p in order], goal, epochs)
    cells, rest = [], dict.fromkeys(goal, 0.0)
    for p, f in zip(order, flows, strict=True):
        for tag, n in copies[p].items():
            full = min(epochs, int((f.get(tag, 0.0) + _EPS) // n)) if n else 0
            more = max(0.0, f.get(tag, 0.0) - full * n)
            rest[tag] += more
            cells.append((p, tag, full, more / n if n else 0.0))
    small = len(cells) <= SMALL_TABLE
    known = spark.createDataFrame(cells, "_pattern string, _tag string, _full int, _odds double")
    if not small:
        known = stored(known)
    shares = spark.createDataFrame([(t, size[t], goal[t], rest[t]) for t in goal], "_tag string, source_size long, target double, rest double")
    placed = stored(_placed(rows, known, small).where("_place is not null").select("_tag", "_size", "_place"))
    return rows, shared, known, small, stored(_selected(placed, shares))


def _selected(placed: DataFrame, shares: DataFrame) -> DataFrame:
    """Adds ``cut`` and ``fills`` to the sources' table.

    The place in which a source's running total passes its ``rest`` is found digit by digit:
    each level sums the cells of one level inside the cell that was passed before.
    """
    edges = shares.select("_tag", "rest", F.lit("").alias("cell"), F.lit(0).cast("long").alias("before"))
    for level in range(1, LEVELS + 1):
        inside = placed.join(F.broadcast(edges), "_tag").where(F.startswith("_place", "cell"))
        cells = inside.groupBy("_tag", "rest", "before", F.substring("_place", 1, DIGITS * level).alias("next")).agg(F.sum("_size").alias("words"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("_tag").orderBy("next"))
        passed = cells.withColumn("upto", upto).where("upto > rest").groupBy("_tag")
        edge = passed.agg(F.min("next").alias("cell"), F.min_by(F.col("upto") - F.col("words"), "next").alias("before"))
        edges = stored(shares.select("_tag", "rest").join(edge, "_tag", "left"))
    # Within it, the last document that still fits.
    inside = placed.join(F.broadcast(edges), "_tag").where(F.startswith("_place", "cell")).groupBy("_tag", "_place", "rest", "before").agg(F.sum("_size").alias("words"))
    inside = inside.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("_tag").orderBy("_place"))).where("upto <= rest")
    last = inside.groupBy("_tag").agg(F.max("_place").alias("cut"), F.max("upto").alias("sum"))
    cuts = edges.join(last, "_tag", "left").select("_tag", F.coalesce("cut", F.col("cell"), F.lit("H")).alias("cut"), (F.col("rest") - F.coalesce("sum", "before", "rest")).alias("left"))
    # Documents beyond the cut that fit what is left best: from below, and at last from either side.
    chosen = stored(cuts.withColumn("fills", F.array().cast("array<string>")))
    for k in range(FILLS):
        final = k == FILLS - 1
        miss = F.col("left") - F.col("_size")
        fits = placed.join(F.broadcast(chosen), "_tag").where((F.col("_place") > F.col("cut")) & ~F.array_contains("fills", F.col("_place")))
        fits = fits.where((F.col("_size") > 0) & ((F.abs(miss) < F.col("left")) if final else (miss >= 0)))
        best = fits.groupBy("_tag").agg(F.min(F.struct(F.abs(miss).alias("miss"), "_place", "_size")).alias("best"))
        more = F.when(F.col("best").isNotNull(), F.concat("fills", F.array("best._place"))).otherwise(F.col("fills"))
        chosen = stored(chosen.join(best, "_tag", "left").select("_tag", "cut", (F.col("left") - F.coalesce("best._size", F.lit(0))).alias("left"), more.alias("fills")))
    return shares.join(chosen.select("_tag", "cut", "fills"), "_tag").select("_tag", "source_size", "target", "cut", "fills")


def mixed_rows(docs: DataFrame, text: str = "text", source: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, size, source_size, target, epochs, taken of every row.

    Where the texts aren't kept, they are read once.  Where they are, a second pass joins them; when few are
    shared, Spark broadcasts the shared ones, so that no text is shuffled.
    """
    narrow = text not in keep
    rows = stored(with_sizes(docs, text, source, keep if narrow else ()))
    patterned, shared, cells, small, sources = plan(rows)
    placed = _placed(patterned if narrow else _patterned(with_sizes(docs, text, source, keep), shared), cells, small)
    out = placed.join(F.broadcast(sources), "_tag")  # MAX_SOURCES rows at most
    again = (F.col("_place") <= F.col("cut")) | F.array_contains("fills", F.col("_place"))
    out = out.withColumn("_times", F.col("_full") + F.coalesce(again, F.lit(False)).cast("int"))
    return out.select(*[F.col(f"_kept{i}").alias(c) for i, c in enumerate(keep)], F.col("_size").alias("size"), "source_size", "target", F.col("_times").alias("epochs"), (F.col("_size") * F.col("_times")).alias("taken"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    ``taken`` are words that the document's own source takes of it.  A null text has size 0
    and is never counted; a null source is a source of its own.  Rows of equal doc_id, source and
    text are taken together; of documents with equal places the smaller digest of doc_id
    comes first.  With no words at all every target is 0, and an empty table gives an empty
    result.  Texts of any length are read whole.  Extra columns are ignored, and the same
    rows give the same result on every run.
    """
    return mixed_rows(docs, text, source).drop("epochs")
