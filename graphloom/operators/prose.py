"""Graphs from prose: node and edge lists in a question's text, and the nodes that a prompt points to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the prose.
NODE_LIST, EDGE_LIST, EDGE = r"nodes\s+(.*?)\.", r"The edges in G are:\s+(.*?)\.", r"\((\d+),\s*(\d+)\)"
LIKES = r"Node (\d+) likes (\w+)\."
#: What the prompt of each kind of problem names.
POINTERS = {
    "connected_nodes": r"connected to (\d+)",
    "disconnected_nodes": r"not connected to (\d+)",
    "edge_existence": r"Is node (\d+) connected to node (\d+)",
    "node_classification": r"Does node (\d+) like",
    "node_degree": r"degree of node (\d+)",
    "reachability": r"path from node (\d+) to node (\d+)",
    "shortest_path": r"shortest path from node (\d+) to node (\d+)",
}
#: Problems about the whole graph: their prompts point to all nodes, to all edges where these are nodes, or to both.
WHOLE = {"cycle_check": "nodes", "node_count": "nodes", "edge_count": "edges", "triangle_counting": "both"}


def prose_nodes(text: Column) -> Column:
    """Node numbers of the list, as written."""
    return F.transform(F.regexp_extract_all(F.regexp_extract(text, NODE_LIST, 1), F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("long"))


def prose_edges(text: Column) -> Column:
    """Edges of the list as structs (u, v), as written."""
    listed = F.regexp_extract(text, EDGE_LIST, 1)
    ends = [F.regexp_extract_all(listed, F.lit(EDGE), F.lit(k)) for k in (1, 2)]
    return F.zip_with(*ends, lambda u, v: F.struct(u.cast("long").alias("u"), v.cast("long").alias("v")))


def preferences(text: Column) -> Column:
    """Map of a node's number to what it likes."""
    found = [F.regexp_extract_all(text, F.lit(LIKES), F.lit(k)) for k in (1, 2)]
    return F.map_from_entries(F.zip_with(*found, lambda n, what: F.struct(n.cast("long"), what)))


def _named(kind: Column, task: Column) -> Column:
    """Numbers that the task names, by kind of problem; null where it names none or the kind is about the whole graph."""
    out = None
    for name, pattern in POINTERS.items():
        groups = pattern.count(r"(\d+)")
        hit = F.when(F.regexp_like(task, F.lit(pattern)), F.array(*(F.regexp_extract(task, pattern, g + 1).cast("long") for g in range(groups))))
        hit = F.coalesce(hit, F.raise_error(F.concat(F.lit("no prompt node in: "), task)).cast("array<bigint>"))
        out = F.when(kind == name, hit) if out is None else out.when(kind == name, hit)
    return out


def prose_graphs(examples: DataFrame, incidence: bool = False, question_node: bool = False, anchor: str = "A:") -> tuple[DataFrame, DataFrame]:
    """Nodes (graph_id, node, text, is_prompt) and directed edges (graph_id, src, dst) of questions in prose.

    examples: (graph_id, problem_type, question, task_description, answer, nnodes, nedges). The lists must have as many nodes and edges
    as nnodes and nedges say. Every edge goes both ways; with incidence it is a node 'u,v' of its own. The prompt node, numbered nnodes
    (nnodes + 1 behind a question node, which has no edges and takes the task up to the anchor), holds task and answer and points to
    what the problem is about. maximum_flow, whose capacities the prose lacks, unknown problems and tasks that name no node are errors.
    """
    kind, known = F.col("problem_type"), [*POINTERS, *WHOLE]
    checked = examples.withColumns({"nodes": prose_nodes(F.col("question")), "pairs": prose_edges(F.col("question"))})
    fault = F.when(~kind.isin(known) | kind.isNull(), F.concat(F.lit("problems of this kind have no graph: "), F.coalesce(kind, F.lit("null"))))
    fault = fault.when(F.size("nodes") != F.col("nnodes").cast("int"), "the number of nodes differs from nnodes")
    fault = fault.when(F.size("pairs") != F.col("nedges").cast("int"), "the number of edges differs from nedges")
    checked = checked.withColumn("nodes", F.when(fault.isNotNull(), F.raise_error(fault).cast("array<bigint>")).otherwise(F.col("nodes")))
    low_high = lambda e: F.struct(F.least(e["u"], e["v"]).alias("u"), F.greatest(e["u"], e["v"]).alias("v"))
    checked = checked.withColumns({"nodes": F.array_distinct("nodes"), "pairs": F.array_distinct(F.transform("pairs", low_high))})

    text = F.col("n").cast("string")
    likes = F.when(kind == "node_classification", F.element_at(preferences(F.col("question")), F.col("n")))
    plain = checked.select("graph_id", "problem_type", "question", F.explode("nodes").alias("n")).select("graph_id", text.alias("node"), F.when(likes.isNotNull(), F.concat(text, F.lit(" likes "), likes)).otherwise(text).alias("text"), F.lit(False).alias("is_prompt"))
    name = F.concat_ws(",", F.col("e.u").cast("string"), F.col("e.v").cast("string"))
    pairs = checked.select("graph_id", F.explode("pairs").alias("e")).select("graph_id", F.col("e.u").cast("string").alias("u"), F.col("e.v").cast("string").alias("v"), name.alias("name"))
    if incidence:
        plain = plain.unionByName(pairs.select("graph_id", F.col("name").alias("node"), F.col("name").alias("text"), F.lit(False).alias("is_prompt")))
        pairs = pairs.select("graph_id", F.explode(F.array_distinct(F.array("u", "v"))).alias("u"), F.col("name").alias("v"))
    edges = pairs.select("graph_id", F.explode(F.array_distinct(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"))))).alias("e")).select("graph_id", "e.*")

    task, answer = F.col("task_description"), F.coalesce(F.col("answer"), F.lit(""))
    number = F.col("nnodes").cast("int") + (1 if question_node else 0)
    prompts = checked.withColumn("prompt", number.cast("string"))
    if question_node:
        at = F.locate(anchor, task)
        at = F.when(at > 0, at).otherwise(F.raise_error(F.lit("no anchor splits the task")).cast("int"))
        extra = prompts.select("graph_id", F.col("nnodes").cast("int").cast("string").alias("node"), F.substring(task, F.lit(1), at - 1).alias("text"), F.lit(False).alias("is_prompt"))
        plain = plain.unionByName(extra)
        task = F.substring(task, at, F.length(task))
    plain = plain.unionByName(prompts.select("graph_id", F.col("prompt").alias("node"), F.concat(task, answer).alias("text"), F.lit(True).alias("is_prompt")))
    numbers = F.transform("nodes", lambda n: n.cast("string"))
    names = F.transform("pairs", lambda e: F.concat_ws(",", e["u"].cast("string"), e["v"].cast("string")))
    every = {"nodes": numbers, "edges": names if incidence else numbers, "both": F.concat(numbers, names) if incidence else numbers}
    whole = None
    for problem, what in WHOLE.items():
        whole = F.when(kind == problem, every[what]) if whole is None else whole.when(kind == problem, every[what])
    targets = F.coalesce(whole, F.transform(_named(kind, F.col("task_description")), lambda n: n.cast("string")))
    links = prompts.select("graph_id", F.col("prompt").alias("src"), F.explode(targets).alias("dst")).distinct()
    return plain, edges.unionByName(links)
