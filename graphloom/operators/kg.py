"""Knowledge-graph questions: triples, names, relation paths, budgets and graph predicates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import text as T
from graphloom.storage import materialize

UNLINKED = "UNLINKED_ENTITY"


def decode_ids(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Replace a column's integer ids by names (id, name); ids without a name become UNLINKED, strings pass through."""
    ids = names.select(F.col("id").cast("string").alias(column), F.col("name").alias("__name"))
    found = rows.join(ids, column, "left")
    return found.withColumn(column, F.when(F.col("__name").isNotNull(), F.col("__name")).when(F.col(column).rlike("^[0-9]+$"), F.lit(UNLINKED)).otherwise(F.col(column))).drop("__name")


def entity_text(node: Column, name: Column) -> Column:
    """A known name, 'unnamed entity' for mediator ids, otherwise the decoded literal."""
    return F.when(name.isNotNull(), name).when(node.rlike(r"^[mg]\."), F.lit("unnamed entity")).otherwise(T.decode_escapes(node))


def merge_names(needed: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """(mid, name, priority): for each needed mid the name of the first source that has one (first by name within it)."""
    every = None
    for rank, source in enumerate(sources):
        part = source.select("mid", "name", F.lit(rank).cast("long").alias("priority"))
        every = part if every is None else every.unionByName(part)
    every = every.join(needed.select("mid").distinct(), "mid", "left_semi")
    return every.groupBy("mid").agg(F.min(F.struct("priority", "name")).alias("x")).select("mid", "x.name", "x.priority")


def follow_paths(triples: DataFrame, paths: DataFrame, max_hops: int) -> DataFrame:
    """Instantiate relation sequences: paths (qid, path, root, relations array) over triples (qid, h, r, t).

    Returns (qid, path, hop, h, r, t). A frontier is a set; each hop is one join."""
    front = paths.select("qid", "path", "relations", F.col("root").alias("h"))
    out = None
    for hop in range(max_hops):
        wanted = front.withColumn("r", F.get("relations", F.lit(hop))).where("r is not null")
        taken = materialize(wanted.join(triples, ["qid", "h", "r"]).select("qid", "path", "relations", "h", "r", "t").distinct(), "kg-hop")
        rows = taken.select("qid", "path", F.lit(hop).cast("long").alias("hop"), "h", "r", "t")
        out = rows if out is None else out.unionByName(rows)
        front = taken.select("qid", "path", "relations", F.col("t").alias("h")).distinct()
    return out


def triplet_graph(triples: DataFrame) -> DataFrame:
    """(qid, src, dst), both ways: triples (qid, ord, h, t) that share an entity.

    Every shared entity is a star of its triples joined through it; within a question's budget the pairs are few."""
    ends = triples.select("qid", "ord", F.explode(F.array_distinct(F.array("h", "t"))).alias("e"))
    a, b = ends.alias("a"), ends.alias("b")
    pairs = a.join(b, F.expr("a.qid = b.qid and a.e = b.e and a.ord < b.ord")).select("a.qid", F.col("a.ord").alias("src"), F.col("b.ord").alias("dst")).distinct()
    return pairs.unionByName(pairs.select("qid", F.col("dst").alias("src"), F.col("src").alias("dst")))


def levi_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations as nodes: nodes (qid, node, is_rel, text) and edges (qid, src, dst) with h -> R<ord> -> t."""
    rel = F.concat(F.lit("R"), F.col("ord").cast("string"))
    ents = triples.select("qid", F.explode(F.array("h", "t")).alias("node")).distinct().select("qid", "node", F.lit(False).alias("is_rel"), F.col("node").alias("text"))
    rels = triples.select("qid", rel.alias("node"), F.lit(True).alias("is_rel"), T.verbalise_relation(F.col("r"), 2).alias("text"))
    edges = triples.select("qid", F.explode(F.array(F.struct(F.col("h").alias("src"), rel.alias("dst")), F.struct(rel.alias("src"), F.col("t").alias("dst")))).alias("e")).select("qid", "e.*").distinct()
    return ents.unionByName(rels), edges


def add_prompt(nodes: DataFrame, edges: DataFrame, topics: DataFrame, prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A PROMPT node for each question (qid, text) with edges to those of its topics (qid, node) that are in the graph."""
    there = topics.join(nodes.select("qid", "node"), ["qid", "node"], "left_semi").distinct()
    extra = prompts.select("qid", F.lit("PROMPT").alias("node"), F.lit(False).alias("is_rel"), "text")
    return nodes.unionByName(extra), edges.unionByName(there.select("qid", F.lit("PROMPT").alias("src"), F.col("node").alias("dst")))


def bfs_order(triples: DataFrame, dist: DataFrame, far: int = 1_000_000_000) -> DataFrame:
    """Rank triples (qid, ord, h, t) by the nearer end's distance (qid, node, dist), then by ord."""
    d = lambda end: dist.select("qid", F.col("node").alias(end), F.col("dist").alias(f"__{end}"))
    near = triples.join(d("h"), ["qid", "h"], "left").join(d("t"), ["qid", "t"], "left")
    key = F.least(F.coalesce("__h", F.lit(far)), F.coalesce("__t", F.lit(far)))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(key, "ord")) - 1
    return near.withColumns({"near": key.cast("long"), "rank": rank.cast("long")}).drop("__h", "__t")


def budgeted_triples(ranked: DataFrame, max_nodes: int) -> DataFrame:
    """Greedy choice by rank: a triple is skipped where its new entities and all relation nodes would exceed max_nodes.

    Input (qid, rank, h, t), output those rows that are kept. One question's triples meet in one task, as the choice is
    sequential; questions are independent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        ends = np.unique(pdf[["h", "t"]].to_numpy(str).ravel(), return_inverse=True)[1].reshape(-1, 2)
        there, used = np.zeros(int(ends.max(initial=-1)) + 1, bool), 1  # the prompt takes a place
        take = np.ones(len(pdf), bool)
        if len(there) + len(pdf) + 1 > max_nodes:
            for i, pair in enumerate(ends):
                cost = 1 + int((~there[np.unique(pair)]).sum())  # the relation, and ends that are new
                take[i] = used + cost <= max_nodes
                if take[i]:
                    there[pair], used = True, used + cost
        return pdf.loc[take, ["qid", "rank", "h", "t"]]

    return ranked.select("qid", "rank", "h", "t").groupBy("qid").applyInPandas(run, f"qid {dict(ranked.dtypes)['qid']}, rank long, h string, t string")


def division(required: DataFrame, granted: DataFrame) -> DataFrame:
    """(id, ok): ids of required (id, item) all of whose items are in granted (id, item)."""
    missing = required.distinct().join(granted.distinct(), ["id", "item"], "left_anti").select("id").distinct().withColumn("bad", F.lit(True))
    return required.select("id").distinct().join(missing, "id", "left").select("id", F.col("bad").isNull().alias("ok"))


def multiset_gaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, only_a, only_b): by id how many items (id, item) one side has beyond the other, as multisets; null for ids that
    the other side lacks altogether is avoided: such an id counts all its items."""
    count = lambda df, c: df.groupBy("id", "item").agg(F.count(F.lit(1)).alias(c))
    both = count(a, "na").join(count(b, "nb"), ["id", "item"], "full_outer").na.fill(0, ["na", "nb"])
    return both.groupBy("id").agg(F.sum(F.greatest(F.col("na") - F.col("nb"), F.lit(0))).alias("only_a"), F.sum(F.greatest(F.col("nb") - F.col("na"), F.lit(0))).alias("only_b"))


def contract_mediators(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove unnamed mediators, joining every relation into them with every relation out of them.

    nodes (qid, node, is_rel, unnamed, is_topic), edges (qid, src, dst) entity -> relation -> entity. A mediator goes if it
    has relations on both sides and at most one entity leads to it through them. In name order: a removal changes what later
    mediators see, so a question's graph is handled whole, questions apart from one another."""

    def run(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        into, out = {}, {}
        for src, dst in zip(e["src"], e["dst"]):
            out.setdefault(src, set()).add(dst)
            into.setdefault(dst, set()).add(src)
        gone = []
        for node in sorted(n.loc[n["unnamed"] & ~n["is_topic"] & ~n["is_rel"], "node"]):
            before, after = into.get(node, set()), out.get(node, set())
            above = set().union(*(into.get(r, set()) for r in before)) if before else set()
            if not before or not after or len(above) > 1:
                continue
            gone.append(node)
            for r in before:
                out[r] = (out[r] - {node}) | after
            for r in after:
                into[r] = (into[r] - {node}) | before
            into.pop(node), out.pop(node)
        rows = [(key[0], s, d) for s, ds in out.items() for d in ds if s not in gone]
        rows += [(key[0], g, None) for g in gone]
        return pd.DataFrame(rows, columns=["qid", "src", "dst"])

    kind = dict(nodes.dtypes)["qid"]
    edges = edges.select(*(F.col(c).alias(c) for c in ("qid", "src", "dst")))  # both sides may come from one table
    done = nodes.groupBy("qid").cogroup(edges.groupBy("qid")).applyInPandas(run, f"qid {kind}, src string, dst string")
    done = materialize(done, "mediators")
    removed = done.where("dst is null").select("qid", F.col("src").alias("node"))
    return nodes.join(removed, ["qid", "node"], "left_anti"), done.where("dst is not null")


def shared_first(edges: DataFrame) -> DataFrame:
    """(graph_id, a, b): pairs a < b of sources whose first targets are the same."""
    first = edges.groupBy("graph_id", "src").agg(F.min("dst").alias("boss"))
    x, y = first.alias("x"), first.alias("y")
    return x.join(y, F.expr("x.graph_id = y.graph_id and x.boss = y.boss and x.src < y.src")).select("x.graph_id", F.col("x.src").alias("a"), F.col("y.src").alias("b"))


def answer_text(answer: Column) -> Column:
    """What an answer (text, kb_id) is scored by: its text, else an id that is a literal; null for a mediator or entity id without text."""
    kb = answer["kb_id"]
    return F.when(answer["text"] != "", answer["text"]).when((kb != "") & ~kb.rlike(r"^[mg]\."), T.decode_escapes(kb))


def gold_texts(answers: Column) -> Column:
    """Different texts of an array of answers, in order; an answer without one is kept under its id, which no prediction matches."""
    shown = F.transform(answers, lambda a: F.coalesce(answer_text(a), F.when(a["kb_id"] != "", a["kb_id"])))
    return F.array_distinct(F.filter(shown, lambda t: t.isNotNull()))


def question_graphs(nodes: DataFrame, edges: DataFrame, topics: DataFrame, prompts: DataFrame, gold: DataFrame, versions: int, most: int, sep: str, seed: str, keep_unanswerable: bool = False) -> tuple[DataFrame, DataFrame]:
    """Graphs of questions in several versions that differ in the order of their answers: nodes (qid, version, node, is_rel, text) and edges
    (qid, version, src, dst), a PROMPT node with question and answers included.

    gold (qid, node, text): answers that are in the graph count, each text once, in an order by the SHA-256 of seed, question, version and
    text; a prompt holds the first most of them, joined by sep. A question without such an answer is left out, or with
    keep_unanswerable kept once, with no answer."""
    there = gold.join(nodes.select("qid", "node"), ["qid", "node"], "left_semi").select("qid", "text").distinct()
    spread = there.withColumn("version", F.explode(F.sequence(F.lit(0), F.lit(versions - 1))))
    mark = F.sha2(F.concat_ws(":", F.lit(seed), F.col("qid").cast("string"), F.col("version").cast("string"), "text"), 256)
    told = spread.groupBy("qid", "version").agg(F.array_sort(F.collect_list(F.struct(mark.alias("mark"), "text"))).alias("x"))
    told = told.select("qid", "version", F.array_join(F.slice(F.transform("x", lambda s: s["text"]), 1, most), sep).alias("answers"))
    if keep_unanswerable:
        none = prompts.select("qid").distinct().join(told, "qid", "left_anti").select("qid", F.lit(0).alias("version"), F.lit("").alias("answers"))
        told = told.unionByName(none)
    told = materialize(told, "question-versions")
    which = told.select("qid", "version")
    asked = prompts.withColumnRenamed("text", "ask").join(told, "qid").select("qid", "version", F.concat("ask", "answers").alias("text"))
    copies = nodes.join(which, "qid").select("qid", "version", "node", "is_rel", "text")
    copies = copies.unionByName(asked.select("qid", "version", F.lit("PROMPT").alias("node"), F.lit(False).alias("is_rel"), "text"))
    linked = topics.join(nodes.select("qid", "node"), ["qid", "node"], "left_semi").distinct().join(which, "qid")
    links = linked.select("qid", "version", F.lit("PROMPT").alias("src"), F.col("node").alias("dst"))
    return copies, edges.join(which, "qid").select("qid", "version", "src", "dst").unionByName(links)
