"""Probe graphs: small labelled examples whose answer needs direction, rings, near colours or a path through texts, and further
synthetic collections. Every graph comes from its own seeded generator, so a partition can make any range of them."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.generators import uniform
from graphloom.operators.hooks import GENERATORS

SCHEMA = "graph_id long, nodes array<struct<node:long,text:string>>, edges array<struct<src:long,dst:long>>, question string, label boolean, a long, b long, facts map<string,double>"
COLOURS = ("red", "blue", "green", "yellow", "purple", "orange")
FIRST = {"He": ("Adam", "Boris", "Carl", "David", "Edgar", "Felix", "Georg", "Hugo"), "She": ("Anna", "Berta", "Clara", "Dora", "Emma", "Frida", "Greta", "Hanna")}
LAST = ("Abel", "Brandt", "Conrad", "Dietz", "Ebert", "Fuchs", "Graf", "Haas", "Jung", "Kern", "Lenz", "Marx")
LIKES = ("tea", "chess", "rain", "jazz", "maps", "bread", "hills", "trains", "ink", "snow")
TIES = ("friend", "neighbour", "cousin", "colleague", "tutor")


def letters(i: int) -> str:
    """A, B, ... Z, AA, AB and so on from 0."""
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def skeleton(rng: random.Random, n: int, most: int = 4, extra: int = 0) -> set[tuple[int, int]]:
    """A random tree on n nodes with up to extra further edges, no degree above most."""
    degree, edges = [0] * n, set()
    for v in range(1, n):
        u = rng.choice([u for u in range(v) if degree[u] < most])
        edges.add((u, v))
        degree[u] += 1
        degree[v] += 1
    for _ in range(extra):
        free = [v for v in range(n) if degree[v] < most]
        if len(free) < 2:
            break
        u, v = sorted(rng.sample(free, 2))
        if (u, v) not in edges:
            edges.add((u, v))
            degree[u] += 1
            degree[v] += 1
    return edges


def orient(rng: random.Random, edges: set[tuple[int, int]], both: float) -> list[tuple[int, int]]:
    out = []
    for u, v in sorted(edges):
        if rng.random() < both:
            out += [(u, v), (v, u)]
        else:
            out.append((u, v) if rng.random() < 0.5 else (v, u))
    return out


def reach(n: int, edges: list[tuple[int, int]], source: int, cutoff: int | None = None) -> dict[int, int]:
    """Directed distances from source."""
    out: dict[int, list[int]] = {}
    for u, v in edges:
        out.setdefault(u, []).append(v)
    dist, front = {source: 0}, [source]
    while front and (cutoff is None or dist[front[0]] < cutoff):
        front = [w for v in front for w in out.get(v, ()) if w not in dist and not dist.update({w: dist[v] + 1})]
    return dist


def _pair(rng: random.Random, n: int, edges: list[tuple[int, int]], label: bool) -> tuple[int, int, str] | None:
    """Two nodes with a path from the first to the second, or without one: then half of the time the path leads back instead."""
    far = [reach(n, edges, v) for v in range(n)]
    pairs = [(x, y) for x in range(n) for y in range(n) if x != y and (y in far[x]) == label]
    back = [(x, y) for x, y in pairs if x in far[y]]
    if not label and back and (rng.random() < 0.5 or len(back) == len(pairs)):
        return *rng.choice(back), "reversed"
    pairs = pairs if label else [p for p in pairs if p not in set(back)]
    return (*rng.choice(pairs), "" if label else "apart") if pairs else None


def _directed(rng: random.Random, low: int, high: int, both: float, most: int) -> tuple[int, list, bool, tuple]:
    while True:
        n = rng.randint(low, high)
        edges = orient(rng, skeleton(rng, n, most, max(1, n // 4)), both)
        label = rng.random() < 0.5
        if pair := _pair(rng, n, edges, label):
            return n, edges, label, pair


@GENERATORS.add("direction")
def direction(rng: random.Random, low: int, high: int, both: float = 0.2) -> dict:
    """Is there a directed path between two nodes?"""
    n, edges, label, (x, y, kind) = _directed(rng, low, high, both, 4)
    return {"texts": [letters(i) for i in range(n)], "edges": edges, "label": label, "a": x, "b": y, "facts": {kind: 1.0} if kind else {}, "question": f"Is there a directed path from {letters(x)} to {letters(y)}?"}


@GENERATORS.add("substructure")
def substructure(rng: random.Random, low: int, high: int) -> dict:
    """Is a node on a ring? Rings of 3 to 8 nodes hang on single nodes, so every cycle is one of them; the rest is trees."""
    target, degree, edges, ring = rng.randint(low, high), [], set(), set()

    def add(u: int, v: int) -> None:
        while len(degree) <= max(u, v):
            degree.append(0)
        edges.add((min(u, v), max(u, v)))
        degree[u] += 1
        degree[v] += 1

    def close(nodes: list[int]) -> None:
        for u, v in zip(nodes, [*nodes[1:], nodes[0]], strict=True):
            add(u, v)
        ring.update(nodes)

    close(list(range(rng.randint(3, min(8, max(3, target - 1))))))
    while len(degree) < target or len(ring) == len(degree):
        left, free = target - len(degree), [v for v, d in enumerate(degree) if d <= 2]
        if left >= 3 and free and rng.random() < 0.5:
            size = rng.randint(3, min(8, left))
            close([rng.choice(free), *range(len(degree), len(degree) + size - 1)])
        else:
            add(rng.choice([v for v, d in enumerate(degree) if d < 4]), len(degree))
    label = rng.random() < 0.5
    x = rng.choice(sorted(ring) if label else sorted(set(range(len(degree))) - ring))
    return {"texts": [letters(i) for i in range(len(degree))], "edges": [p for u, v in sorted(edges) for p in ((u, v), (v, u))], "label": label, "a": x, "b": None, "facts": {"ring_share": len(ring) / len(degree)}, "question": f"Is the node {letters(x)} part of a ring?"}


@GENERATORS.add("local_hop")
def local_hop(rng: random.Random, low: int, high: int, radius: int = 2, colours: int = 4, both: float = 0.2) -> dict:
    """Is a colour near? A node of that colour always stands beyond the radius too, so that the colour alone tells nothing."""
    while True:
        n = rng.randint(low, high)
        edges = orient(rng, skeleton(rng, n, 4, max(1, n // 4)), both)
        choice = []
        for x in range(n):
            near = reach(n, edges, x, radius)
            if 1 < len(near) < n:
                choice.append((x, sorted(set(near) - {x}), sorted(set(range(n)) - set(near))))
        if choice:
            break
    x, ball, beyond = rng.choice(choice)
    paint = [rng.choice(COLOURS[:colours]) for _ in range(n)]
    wanted, label = rng.choice([c for c in COLOURS[:colours] if c != paint[x]]), rng.random() < 0.5
    others = [c for c in COLOURS[:colours] if c != wanted]
    paint = [rng.choice(others) if v in ball and c == wanted and not label else c for v, c in enumerate(paint)]
    if label:
        paint[rng.choice(ball)] = wanted
    if all(paint[v] != wanted for v in beyond):
        paint[rng.choice(beyond)] = wanted
    return {"texts": [f"{letters(v)}: {c}" for v, c in enumerate(paint)], "edges": edges, "label": label, "a": x, "b": None, "facts": {"ball": float(len(ball))}, "question": f"Is there a {wanted} node within {radius} hops of {letters(x)} (following edge directions)?"}


def unique_people(rng: random.Random, n: int) -> list[tuple[str, str]]:
    """n different (name, pronoun) pairs."""
    every = [(f"{first} {last}", who) for who, names in FIRST.items() for first in names for last in LAST]
    if n > len(every):
        raise ValueError(f"there are only {len(every)} names")
    return rng.sample(every, n)


def person_bio(rng: random.Random, name: str, who: str, ties: list[str]) -> str:
    """Sentences about a person, likes first, the others shuffled; each name in ties is mentioned exactly once."""
    likes = rng.sample(LIKES, rng.randint(2, 3))
    rest = [f"{who} is {rng.randint(18, 80)} years old.", f"{who} lives in house {rng.randint(1, 99)}."]
    rest += [f"{'His' if who == 'He' else 'Her'} {rng.choice(TIES)} is {other}." for other in ties]
    rng.shuffle(rest)
    return " ".join([f"{name} likes {', '.join(likes[:-1])} and {likes[-1]}.", *rest])


@GENERATORS.add("text_path")
def text_path(rng: random.Random, low: int, high: int, both: float = 0.2) -> dict:
    """Is there a chain of mentions between two people? Mentions in the texts and edges are the same."""
    n, edges, label, (x, y, kind) = _directed(rng, low, high, both, 3)
    people = unique_people(rng, n)
    texts = [person_bio(rng, *people[v], [people[w][0] for u, w in edges if u == v]) for v in range(n)]
    return {"texts": texts, "edges": edges, "label": label, "a": x, "b": y, "facts": {kind: 1.0} if kind else {}, "question": f"Is there a chain of acquaintances leading from {people[x][0]} to {people[y][0]}?"}


@GENERATORS.add("random")
def random_texts(rng: random.Random, low: int, high: int, attach: int = 2, directed: float = 0.0) -> dict:
    """Graphs by preferential attachment, or with directed > 0 each ordered pair with that probability; the label is whether node 0 has
    the largest degree (out-degree)."""
    n, edges = rng.randint(low, high), set()
    if directed > 0:
        edges = {(u, v) for u in range(n) for v in range(n) if u != v and rng.random() < directed}
    else:
        ends = list(range(attach))
        for v in range(attach, n):
            chosen: set[int] = set()
            while len(chosen) < min(attach, v):
                chosen.add(rng.choice(ends))
            edges |= {p for u in chosen for p in ((u, v), (v, u))}
            ends += [*chosen, *[v] * len(chosen)]
    degree = [sum(u == v for u, _ in edges) for v in range(n)]
    return {"texts": [f"node {v}" for v in range(n)], "edges": sorted(edges), "label": degree[0] == max(degree), "a": 0, "b": None, "facts": {}, "question": "Has node 0 the most neighbours?"}


def probe_examples(spark: SparkSession, kind: str, graphs: int, low: int, high: int, seed: str, **options) -> DataFrame:
    """graphs examples of a registered kind (SCHEMA). The same seed and id give the same graph on any cluster."""
    make: Callable[..., dict] = GENERATORS.get(kind)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for g in batch["id"].tolist():
                x = make(random.Random(f"{seed}:{kind}:{g}"), low, high, **options)
                rows.append((g, [{"node": i, "text": t} for i, t in enumerate(x["texts"])], [{"src": u, "dst": v} for u, v in x["edges"]], x["question"], x["label"], x["a"], x["b"], x["facts"]))
            frame = pd.DataFrame(rows, columns=["graph_id", "nodes", "edges", "question", "label", "a", "b", "facts"])
            yield frame.astype({"b": "Int64"})

    return spark.range(graphs).mapInPandas(run, SCHEMA)


def probe_graphs(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph_id, node, text) and edges (graph_id, src, dst); the prompt, numbered behind all nodes, asks and answers, and points to
    the nodes asked about."""
    prompt = F.size("nodes").cast("long")
    text = F.concat_ws(" ", "question", F.when(F.col("label"), "Yes").otherwise("No"))
    nodes = examples.select("graph_id", F.explode("nodes").alias("n")).select("graph_id", "n.*").unionByName(examples.select("graph_id", prompt.alias("node"), text.alias("text")))
    asked = examples.select("graph_id", prompt.alias("src"), F.explode(F.array_compact(F.array("a", "b"))).alias("dst"))
    return nodes, examples.select("graph_id", F.explode("edges").alias("e")).select("graph_id", "e.*").unionByName(asked)


def star_graphs(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Needle cells as stars: a question (node 0) and prompt (node 1) besides content nodes 2.., each of which states its code; the prompt
    points to every content node. cells: (example, cell_n, cell_t, gold_slot, codes), where a slot is a place among the codes."""
    key = ("example", "cell_n", "cell_t")
    spread = cells.select(*key, F.posexplode("codes").alias("slot", "code"))
    name = F.format_string("NODE-%05d", "slot")
    content = spread.select(*key, (F.col("slot") + 2).cast("long").alias("node"), F.concat(F.lit("The code of "), name, F.lit(" is "), F.col("code"), F.lit(".")).alias("text"))
    ask = cells.select(*key, F.lit(0).cast("long").alias("node"), F.format_string("What is the code of NODE-%05d?", "gold_slot").alias("text"))
    prompt = cells.select(*key, F.lit(1).cast("long").alias("node"), F.concat(F.lit("A: "), F.get("codes", F.col("gold_slot").cast("int"))).alias("text"))
    return content.unionByName(ask).unionByName(prompt), content.select(*key, F.lit(1).cast("long").alias("src"), F.col("node").alias("dst"))


def chain_graphs(cells: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Needle cells as pointer chains: the question names the head, hops links lead from node to node by name, and the last one states the
    code. All other nodes point to nodes off the chain (decoys), so pointing alone tells nothing. Nodes (.., node, text, place on
    the chain or null) and edges from each node to the one it names. A cell needs hops + 1 slots on the chain and two beside it."""
    key = ("example", "cell_n", "cell_t")
    slots = cells.select(*key, F.posexplode("codes").alias("slot", "code"))
    order = uniform("chain", F.col("example"), F.col("slot"))  # the same in all cells of an example, so a smaller one holds the same chain
    from pyspark.sql.window import Window

    least = F.min("cell_n").over(Window.partitionBy("example"))
    slots = slots.withColumn("least", least).withColumn("inner", (F.col("slot") < F.col("least")).cast("int"))
    w = Window.partitionBy(*key)
    ranked = slots.withColumn("place", F.row_number().over(w.orderBy(F.desc("inner"), order, "slot")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    on = F.col("place") <= hops
    # a decoy names the next one off the chain, the last the first
    goal = F.when(F.col("place") < hops, F.col("place") + 1).when(~on, F.when(F.col("place") + 1 < F.col("n"), F.col("place") + 1).otherwise(F.lit(hops + 1)))
    ranked = ranked.withColumn("goal", goal)
    target = ranked.select(*key, F.col("place").alias("goal"), F.col("slot").alias("to"))
    joined = ranked.join(target, [*key, "goal"], "left")
    name = lambda c: F.format_string("NODE-%05d", c)
    text = F.when(F.col("to").isNull(), F.concat(F.lit("The code of "), name("slot"), F.lit(" is "), F.col("code"), F.lit("."))).otherwise(F.concat(name("slot"), F.lit(" points to "), name("to"), F.lit(".")))
    nodes = joined.select(*key, F.col("slot").cast("long").alias("node"), text.alias("text"), F.when(on, F.col("place")).cast("long").alias("place"))
    return nodes, joined.where("to is not null").select(*key, F.col("slot").cast("long").alias("src"), F.col("to").cast("long").alias("dst"))


def sampled_lengths(items: DataFrame, histogram: DataFrame, seed: str, *keys: str) -> DataFrame:
    """items with length: a draw from histogram (length, n) by the inverse of its cumulative share, at a point that keys fix.
    The histogram has a row for each length, so it is small."""
    from pyspark.sql.window import Window

    upto = F.sum("n").over(Window.orderBy("length"))
    total = histogram.agg(F.sum("n").alias("total"))
    steps = histogram.crossJoin(F.broadcast(total)).select("length", ((upto - F.col("n")) / F.col("total")).alias("lo"), (upto / F.col("total")).alias("hi"))
    table = steps.agg(F.array_sort(F.collect_list(F.struct("hi", "length"))).alias("steps"))
    placed = items.withColumn("__u", uniform(seed, *map(F.col, keys))).crossJoin(F.broadcast(table))
    first = F.get(F.filter("steps", lambda s: s["hi"] > F.col("__u")), F.lit(0))
    return placed.withColumn("length", first["length"]).drop("__u", "steps")


def length_fidelity(drawn: DataFrame, histogram: DataFrame) -> DataFrame:
    """(distance): largest gap between the cumulative shares of drawn lengths and the histogram's."""
    from pyspark.sql.window import Window

    own = drawn.groupBy("length").agg(F.count(F.lit(1)).alias("m"))
    both = own.join(histogram, "length", "full_outer").na.fill(0, ["m", "n"])
    w = Window.orderBy("length")  # a row for each length
    sums = both.withColumns({"a": F.sum("m").over(w), "b": F.sum("n").over(w)})
    ends = both.agg(F.sum("m").alias("ta"), F.sum("n").alias("tb"))
    return sums.crossJoin(F.broadcast(ends)).agg(F.max(F.abs(F.col("a") / F.col("ta") - F.col("b") / F.col("tb"))).alias("distance"))


def kinship_questions(people: DataFrame, kin: DataFrame, seed: str) -> DataFrame:
    """(graph_id, a, relation, k, answer, question): for each graph one question with one answer: who is the k-th oldest R of a? Drawn by hash
    among all (a, relation, k); a group of relatives two of whom are as old is left out. people has (graph_id, person, born), kin
    (graph_id, a, relation, b)."""
    from pyspark.sql.window import Window

    from graphloom.functions.text import ordinal

    born = people.select("graph_id", F.col("person").alias("b"), "born")
    group = Window.partitionBy("graph_id", "a", "relation")
    aged = kin.join(born, ["graph_id", "b"]).withColumns({"k": F.row_number().over(group.orderBy("born", "b")), "same": F.count(F.lit(1)).over(Window.partitionBy("graph_id", "a", "relation", "born"))})
    clear = aged.withColumn("worst", F.max("same").over(group)).where("worst = 1")
    mark = F.struct(uniform(seed, F.col("graph_id"), F.col("a"), F.col("relation"), F.col("k")).alias("u"), "a", "relation", "k", F.col("b").alias("answer"))
    drawn = clear.groupBy("graph_id").agg(F.min(mark).alias("x")).select("graph_id", "x.a", "x.relation", "x.k", "x.answer")
    text = F.concat(F.lit("Who is the "), ordinal(F.col("k")), F.lit(" oldest "), F.replace("relation", F.lit("_"), F.lit(" ")), F.lit(" of person "), F.col("a").cast("string"), F.lit("?"))
    return drawn.withColumn("question", text)


def company_graphs(spark: SparkSession, graphs: int, things: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """Knowledge graphs of a company: nodes (graph_id, node, kind) of people (55 %), skills (20 %) and projects (25 %), and edges
    (graph_id, src, relation, dst). People report to an earlier person, so they form a tree under person 0; numbers of skills, projects
    and requirements fall off geometrically, from one on."""
    share = uniform(seed, F.col("graph_id"), F.col("node"), "kind")
    grid = spark.range(graphs * things).select(F.floor(F.col("id") / things).alias("graph_id"), (F.col("id") % things).alias("node"))
    kind = F.when((F.col("node") == 0) | (share < 0.55), "person").when(share < 0.75, "skill").otherwise("project")
    nodes = grid.withColumn("kind", F.when(F.col("node") == 1, "skill").when(F.col("node") == 2, "project").otherwise(kind))
    lists = nodes.groupBy("graph_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("node")))).alias(k) for k in ("person", "skill", "project")))
    every = nodes.join(lists, "graph_id")

    def picks(source: str, relation: str, pool: str) -> DataFrame:
        u = lambda i: uniform(seed, F.col("graph_id"), F.col("node"), relation, i)
        many = F.least(F.lit(1) + F.floor(F.log(F.greatest(1.0 - u("n"), F.lit(1e-9))) / F.log(F.lit(0.5))), F.size(pool)).cast("int")
        drawn = F.transform(F.sequence(F.lit(1), many), lambda i: F.get(pool, F.floor(u(i) * F.size(pool)).cast("int")))
        return every.where(F.col("kind") == source).select("graph_id", F.col("node").alias("src"), F.lit(relation).alias("relation"), F.explode(F.array_distinct(drawn)).alias("dst"))

    above = F.filter("person", lambda p: p < F.col("node"))
    boss = F.get(above, F.floor(uniform(seed, F.col("graph_id"), F.col("node"), "boss") * F.size(above)).cast("int"))
    reports = every.where("kind = 'person' and node > 0").select("graph_id", F.col("node").alias("src"), F.lit("REPORTS_TO").alias("relation"), boss.alias("dst"))
    return nodes, reports.unionByName(picks("person", "HAS_SKILL", "skill")).unionByName(picks("person", "WORKS_ON", "project")).unionByName(picks("project", "REQUIRES", "skill"))


def balanced(questions: DataFrame, label: str, order: Column, *keys: str) -> DataFrame:
    """As many questions of either label for each key: the surplus of the larger side goes, last by order first."""
    from pyspark.sql.window import Window

    ranked = questions.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys, label).orderBy(order)))
    sides = questions.groupBy(*keys).agg(F.least(F.count(F.when(F.col(label), 1)), F.count(F.when(~F.col(label), 1))).alias("__most"))
    return ranked.join(sides, list(keys)).where(F.col("__rank") <= F.col("__most")).drop("__rank", "__most")
