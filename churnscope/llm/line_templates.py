"""Line deduplication with a log-template tree.

Lines are parsed to a fixed depth: the number of tokens, then the leading
tokens, in which tokens with digits are wild. Lines that meet in a leaf share
these; within a leaf a token is constant where enough documents have it at its
position, and a variable field elsewhere. What remains of a line, constants and
``<*>``, is its template. A template found in at least ``min_docs`` documents
is boilerplate: its lines are dropped from every document.

All built-in functions. Work narrows before it widens: per document each
different line counts once, leaves are counted by hash (partial aggregation
takes a line that a third of the corpus holds to one row per map task), and
only lines in leaves with enough documents are taken apart into tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.llm.common import WHITE, Scratch, sized

WILD = "<*>"


@dataclass(frozen=True)
class TemplateParams:
    """``depth`` leading tokens lead to a leaf; templates of ``min_docs`` documents are dropped if at
    least ``min_constant`` percent of their tokens are constant and they have ``min_tokens`` tokens."""

    depth: int = 3
    min_docs: int = 10
    min_constant: int = 60
    min_tokens: int = 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def tokens_of(line: Column) -> Column:
    return F.filter(F.split(line, WHITE), lambda t: t != "")


def masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(WILD)).otherwise(token)


def leaf_of(tokens: Column, depth: int) -> Column:
    """The leaf's key: token count and leading tokens."""
    lead = F.transform(F.slice(tokens, 1, depth), masked)
    return F.concat_ws("\x1f", F.size(tokens).cast("string"), F.array_join(lead, "\x1f"))


def leaf_lines(docs: DataFrame, id_col: str, text_col: str, p: TemplateParams) -> DataFrame:
    """(id, line hash, leaf hash, tokens): each different line of each document once."""
    own = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(lines_of(F.col(text_col)))).alias("line"))
    own = own.withColumn("tokens", tokens_of(F.col("line"))).where(F.size("tokens") >= p.min_tokens)
    return own.select("id", line_hash(F.col("line")).alias("line"), F.xxhash64(leaf_of(F.col("tokens"), p.depth)).alias("leaf"), "tokens")


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def find_templates(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, p: TemplateParams) -> tuple[DataFrame, DataFrame]:
    """(lines, templates): the hash of each line to drop with its template; template, n_docs, constant."""
    own = leaf_lines(docs, id_col, text_col, p)
    # Leaves by hash first: a row a leaf and map task, no text in the shuffle. Lines are
    # counted here, of which there are no fewer than documents.
    often = scratch.stage(own.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= p.min_docs).select("leaf"), "lines-leaves")
    kept = own.join(sized(often), "leaf", "left_semi")
    # Each different line of these leaves once, with the number of its documents.
    whole = scratch.stage(kept.groupBy("leaf", "line", "tokens").agg(F.count(F.lit(1)).alias("docs")), "lines-lines")
    fields = whole.select("leaf", "line", "docs", F.posexplode("tokens").alias("position", "token"), F.size("tokens").alias("tokens"))
    fields = fields.withColumn("token", masked(F.col("token")))
    constant = fields.where(F.col("token") != WILD).groupBy("leaf", "position", "token").agg(F.sum("docs").alias("n"))
    constant = scratch.stage(constant.where(F.col("n") >= p.min_docs).select("leaf", "position", "token", F.lit(True).alias("constant")), "lines-constants")
    marked = fields.join(sized(constant), ["leaf", "position", "token"], "left")
    # A line's own tokens come together again: at most its length.
    shape = F.transform(F.array_sort(F.collect_list(F.struct("position", F.when(F.col("constant"), F.col("token")).otherwise(F.lit(WILD)).alias("t")))), lambda s: s["t"])
    marked = marked.groupBy("leaf", "line", "tokens").agg(shape.alias("shape"), F.count("constant").alias("constants"))
    marked = marked.where(F.col("constants") * 100 >= F.col("tokens") * p.min_constant)
    marked = scratch.stage(marked.select("line", F.array_join("shape", " ").alias("template"), (F.col("constants") * 100 / F.col("tokens")).alias("constant")), "lines-marked")
    # Now documents, each once a template.
    held = own.select("id", "line").join(sized(marked.select("line", "template")), "line").select("template", "id").distinct()
    found = held.groupBy("template").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= p.min_docs)
    found = scratch.stage(found.join(marked.groupBy("template").agg(F.max("constant").alias("constant")), "template"), "lines-templates")
    lines = scratch.stage(marked.join(sized(found.select("template")), "template", "left_semi").select("line", "template"), "lines-dropped")
    scratch.drop([often, whole, constant, marked])
    return lines, found


def drop_template_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: TemplateParams = TemplateParams()) -> DataFrame:
    """One row per document: ``id_col``, n_lines, n_dropped, dropped (line numbers from 0), text (what stays).

    Lines end at line feeds. A line is dropped if its template recurs, whatever
    the values of its variable fields; lines of fewer than ``min_tokens`` tokens
    stay. Rows that share an id count as one document, rows without an id
    together as one; all are cleaned. Null and empty texts have one empty line,
    which stays. An empty table gives no rows; other columns are not read.
    """
    p, scratch = params, Scratch(docs.sparkSession)
    lines, _ = find_templates(docs, scratch, id_col, text_col, p)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("whole", F.xxhash64("text"))
    spots = own.select("id", "whole", F.posexplode(lines_of(F.col("text"))).alias("position", "line")).withColumn("line", line_hash(F.col("line")))
    spots = spots.join(sized(lines.select("line").distinct()), "line", "left_semi")
    # At most a document's own lines come together.
    dropped = scratch.stage(spots.groupBy("id", "whole").agg(F.array_sort(F.collect_set("position")).alias("dropped")), "lines-spots")
    scratch.drop([lines])
    places = dropped.agg(F.coalesce(F.sum(F.size("dropped")), F.lit(0))).first()[0]
    dropped = sized(dropped.select(F.col("id").alias("id2"), F.col("whole").alias("whole2"), "dropped"), places)
    out = own.join(dropped, F.col("id").eqNullSafe(F.col("id2")) & (F.col("whole") == F.col("whole2")), "left")
    out = out.withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>"))).withColumn("lines", lines_of(F.col("text")))
    stays = F.array_join(F.filter("lines", lambda line, i: ~F.array_contains("dropped", i)), "\n")
    return out.select(F.col("id").alias(id_col), F.size("lines").alias("n_lines"), F.size("dropped").alias("n_dropped"), "dropped", stays.alias("text"))
