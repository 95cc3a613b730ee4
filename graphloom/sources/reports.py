"""Small reports from DataFrames whose rows are few, and dumps that replace a table at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.sinks import cell
from graphloom.storage import replace_table


def write_predictions(rows: DataFrame, path: str) -> None:
    """(row_id, margin, y_true) as a table that replaces the one before; row ids must be unique and not null."""
    rows = rows.select(F.col("row_id").cast("long").alias("row_id"), F.col("margin").cast("double").alias("margin"), F.col("y_true").cast("double").alias("y_true"))
    bad = rows.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).where("row_id is null or n > 1")
    if not bad.isEmpty():
        raise ValueError("row ids are null or repeat")
    replace_table(rows, path, "parquet")


def pivot_markdown(rows: DataFrame, row: str, column: str, value: str, digits: int = 3) -> str:
    """Means of value as a pipe table, row by column, both in rising order; '-' where there is none."""
    found = rows.groupBy(row, column).agg(F.avg(value).alias("v")).collect()
    down, across = sorted({r[row] for r in found}), sorted({r[column] for r in found})
    means = {(r[row], r[column]): r["v"] for r in found}
    show = lambda v: "-" if v is None else f"{v:.{digits}f}"
    lines = [[f"{row} \\ {column}", *map(str, across)], ["---"] * (len(across) + 1)]
    lines += [[str(a), *(show(means.get((a, b))) for b in across)] for a in down]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def grid_markdown(cells: DataFrame, metric: str = "em", count: str = "n") -> str:
    """For each k a table of pooled values by nodes (down) and tokens (across): cells (k, nodes, tokens, metric, n) of shards are
    pooled by hits, rounded in each shard, over all n. A value is followed by its n where this is not that of the most cells."""
    hits = F.sum(F.round(F.col(metric) * F.col(count)))
    pooled = cells.groupBy("k", "nodes", "tokens").agg((hits / F.sum(count)).alias("v"), F.sum(count).alias("m")).collect()
    usual = max(sorted({r["m"] for r in pooled}), key=[r["m"] for r in pooled].count, default=None)
    parts = []
    for k in sorted({r["k"] for r in pooled}):
        own = {(r["nodes"], r["tokens"]): r for r in pooled if r["k"] == k}
        across = sorted({t for _, t in own})
        show = lambda r: "" if r is None else f"{r['v']:.3f}" + (f" (n={r['m']})" if r["m"] != usual else "")
        lines = [["N \\ T", *map(str, across)], ["---:"] * (len(across) + 1)]
        lines += [[str(n), *(show(own.get((n, t))) for t in across)] for n in sorted({n for n, _ in own})]
        parts.append(f"k = {k}\n\n" + "\n".join("| " + " | ".join(line) + " |" for line in lines))
    return "\n\n".join(parts)


_LATEX = str.maketrans({"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"})


def latex_table(rows: list[dict], label: str, columns: list[str], digits: int = 1, caption: str = "") -> str:
    """A tabular of scores: in each column the best value is bold and the second best underlined, by what is printed, so that
    ties share their mark. rows: a label and a number (or None) for each column."""
    text = lambda v: "--" if v is None else f"{v:.{digits}f}"
    marks: dict[str, dict[str, str]] = {}
    for c in columns:
        shown = sorted({float(text(r.get(c))) for r in rows if r.get(c) is not None}, reverse=True)
        marks[c] = {text(v): form for v, form in zip(shown, (r"\textbf{%s}", r"\underline{%s}"), strict=False)}
    body = [[str(r[label]).translate(_LATEX), *(marks[c].get(text(r.get(c)), "%s") % text(r.get(c)) for c in columns)] for r in rows]
    lines = [r"\begin{table}", r"\centering", r"\begin{tabular}{l" + "c" * len(columns) + "}", r"\toprule"]
    lines += [" & ".join([label.translate(_LATEX), *(c.translate(_LATEX) for c in columns)]) + r" \\", r"\midrule"]
    lines += [" & ".join(line) + r" \\" for line in body]
    return "\n".join([*lines, r"\bottomrule", r"\end{tabular}", *([rf"\caption{{{caption.translate(_LATEX)}}}"] if caption else []), r"\end{table}"])


def ascii_tree(edges: list[tuple], root, label=str) -> str:
    """A tree of few nodes (parent, child) as text, children in order; a node that was shown already is not opened again."""
    below: dict = {}
    for a, b in edges:
        below.setdefault(a, []).append(b)
    lines, seen, todo = [], set(), [(root, "", "")]
    while todo:
        node, lead, rest = todo.pop()
        again = node in seen
        lines.append(lead + label(node) + (" ..." if again and below.get(node) else ""))
        seen.add(node)
        kids = [] if again else sorted(below.get(node, []))
        todo += [(kid, rest + ("`-- " if i == len(kids) - 1 else "|-- "), rest + ("    " if i == len(kids) - 1 else "|   ")) for i, kid in reversed(list(enumerate(kids)))]
    return "\n".join(lines)


def document_stats(nodes: DataFrame, limit: int) -> DataFrame:
    """(docs, nodes and characters: mean, p50, p90, max; cut_share): sizes of documents made of nodes (graph_id, text), and the share
    of those longer than limit characters, which a dump cuts."""
    sizes = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    facts = [F.count(F.lit(1)).alias("docs"), F.avg((F.col("chars") > limit).cast("double")).alias("cut_share")]
    for c in ("nodes", "chars"):
        facts += [F.avg(c).alias(f"{c}_mean"), F.expr(f"percentile({c}, 0.5)").alias(f"{c}_p50"), F.expr(f"percentile({c}, 0.9)").alias(f"{c}_p90"), F.max(c).alias(f"{c}_max")]
    return sizes.agg(*facts)


def dump_documents(nodes: DataFrame, limit: int, order: str = "node") -> DataFrame:
    """(graph_id, document, cut): a document's node texts, one to a line in order, cut at limit characters with a note of what is missing."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"])
    whole = nodes.groupBy("graph_id").agg(F.array_join(lines, "\n").alias("whole"))
    left = F.length("whole") - limit
    note = F.concat(F.substring("whole", 1, limit), F.lit("\n... ["), left.cast("string"), F.lit(" more characters]"))
    return whole.select("graph_id", F.when(left > 0, note).otherwise(F.col("whole")).alias("document"), (left > 0).alias("cut"))


def show_row(row: dict) -> str:
    """A record as 'key: value' lines, values as in reports."""
    return "\n".join(f"{k}: {cell(v)}" for k, v in row.items())
