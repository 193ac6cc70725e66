"""The code graph for other tools: JSON lines by kind, and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMAT = "code-graph/1"


def lines(symbols: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """kind (file, node, edge, memory_link), key and body, a JSON object, of symbols (symbol, name, fqname, file), edges (src, dst)
    and links (symbol, id, confidence).

    A node has what it calls and is called by, in numbers; a file its symbols, in order.
    Nothing is cut off; fields that are null are left out of the objects.
    """
    out, into = (edges.groupBy(F.col(a).alias("symbol")).agg(F.count(F.lit(1)).alias(n)) for a, n in (("src", "calls"), ("dst", "callers")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    nodes = symbols.join(out, "symbol", "left").join(into, "symbol", "left").select(F.col("symbol").cast("string").alias("key"), F.to_json(F.struct("symbol", "name", "fqname", "file", zero("calls"), zero("callers"))).alias("body"))
    files = symbols.filter("file is not null").groupBy("file").agg(F.array_sort(F.collect_list("symbol")).alias("symbols")).select(F.col("file").alias("key"), F.to_json(F.struct("file", "symbols")).alias("body"))
    calls = edges.select(F.concat_ws("|", "src", "dst").alias("key"), F.to_json(F.struct("src", "dst")).alias("body"))
    held = links.select(F.concat_ws("|", "symbol", "id").alias("key"), F.to_json(F.struct("symbol", "id", "confidence")).alias("body"))
    parts = (("file", files), ("node", nodes), ("edge", calls), ("memory_link", held))
    each = [df.select(F.lit(kind).alias("kind"), "key", "body") for kind, df in parts]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


def write(symbols: DataFrame, edges: DataFrame, links: DataFrame, folder: str) -> None:
    """The lines as text files, a folder for each kind."""
    lines(symbols, edges, links).select("kind", "body").write.mode("overwrite").partitionBy("kind").text(folder)


def report(symbols: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """One row, text: the counts and the ``top`` symbols with the most calls in and out, as Markdown."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("symbol")).groupBy("symbol").agg(F.count(F.lit(1)).alias("degree"))
    name = F.coalesce("fqname", "name", F.col("symbol").cast("string"))
    best = symbols.join(ends, "symbol").select(F.col("degree"), name.alias("name")).orderBy(F.desc("degree"), "name").limit(top)
    hot = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("less"), "name"))).alias("hot"))
    n = symbols.agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("file").alias("files")).join(edges.agg(F.count(F.lit(1)).alias("edges"))).join(hot)  # one row each
    said = F.transform("hot", lambda x: F.concat(F.lit("- `"), x["name"], F.lit("`, degree "), (-x["less"]).cast("string")))
    body = F.when(F.size("hot") > 0, F.array_join(said, "\n")).otherwise("- No connected symbols yet.")
    count = lambda label, c: F.concat(F.lit(f"- {label}: "), F.col(c).cast("string"))
    return n.select(F.concat_ws("\n", F.lit(f"# Code graph ({FORMAT})\n"), count("Files", "files"), count("Symbols", "symbols"), count("Relationships", "edges"), F.lit("\n## Hotspots\n"), body).alias("text"))
