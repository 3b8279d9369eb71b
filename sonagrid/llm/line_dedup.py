"""Line dedup by a log-template tree, in DataFrame functions only.

Each line is cut into tokens, tokens with digits become a variable field. A tree of fixed depth sorts lines: first by
their number of tokens, then by the leading tokens. Inside a leaf two lines that agree in `similarity` of their tokens
are linked, and linked lines propose a template: the tokens that more than half of them have, and variable fields where
there is no such token (`generalised`). The lines that agree with its fixed tokens in `similarity` of their places are
its members; so lines that only a chain links are not. Those left beside a template's members propose again, so a leaf
holds as many templates as its lines make. Lines of fewer than 5 tokens leave no place to differ at 0.8; they, and lines
outside all templates, are templates by their masked text.

A template that lines of at least two documents share (short lines: `short_docs` documents; very short lines never
count) is recurring. Its lines stay in the document of the smallest id, and are dropped from all others.

Everything is counted with partial sums: neither a line that a third of all documents share nor a full leaf is gathered
in one task. Line texts are shuffled only for lines in leaves with different lines. Templates with a thousandth of all
lines or more (a thousand of them at most) are broadcast, so that the join by template has no hot key.

Edge cases: a null or empty text has no line and stays; lines of white space stay; null ids come first; rows that agree
in id and text are one document and are edited alike; a document of which every line is dropped has the empty text; an
empty table gives an empty result; very long texts are cut in their own row, and very long lines are lines like others;
other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, join_hot, let, named, scratch, small, table, whole_text, written
from .components import key_groups, similar_components

DEPTH = 3
FIELD = "<*>"
#: How often the lines beside a template's members propose templates again; what is left then is a template by its text.
ROUNDS = 8
#: Up to so many runs of equal tokens are combined to split crowded groups of lines.
FURTHER = 3

#: A template that so many documents have may be joined by broadcast.
HOT_LINES = 1_000


def exploded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rh, pos, n, leaf, h1, h2, masked): the lines, with single spaces between tokens and fields for those with digits.

    h1 and h2 tell masked lines apart; leaf is the hash of the tree's path: the number of tokens and the leading ones.
    """
    text = whole_text(text_col)
    lines = docs.select(named(id_col).alias("id"), F.xxhash64(text).alias("rh"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    # most lines have even spaces and no digits, which plain searches tell sooner than one pattern of alternatives
    odd = F.col("line").contains("  ") | F.col("line").startswith(" ") | F.col("line").endswith(" ") | F.col("line").rlike(r"[\x09-\x0D0-9]")
    clean = F.trim(F.regexp_replace("line", r"[\x20\x09-\x0D]+", " "))
    lines = lines.withColumn("masked", F.when(odd, F.regexp_replace(clean, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(F.col("line")))
    n = F.when(F.col("masked") == "", 0).otherwise(F.length("masked") - F.length(F.replace(F.col("masked"), F.lit(" "), F.lit(""))) + 1)
    lines = lines.withColumn("n", n)
    found = F.struct("n", F.xxhash64("n", F.substring_index("masked", " ", DEPTH)).alias("leaf"), F.xxhash64("masked").alias("h1"), F.hash("masked").alias("h2"), "masked")
    # a generator of one row: filters and join keys on these columns are not moved before it, so it is computed once
    return lines.select("id", "rh", "pos", F.inline(F.array(found)))


def _differing(n: Column, similarity: float) -> Column:
    """In how many of n places two lines of that similarity may differ."""
    return n - F.ceil(similarity * n - 1e-9)


def linked_lines(own: DataFrame, similarity: float) -> DataFrame:
    """(v, root) of the lines (v, leaf, tokens) that are linked with others of their leaf.

    Two lines that differ in d places at most agree in k of d + k runs of places at least: the runs are the keys, and of
    lines that crowd in one the combinations of k of d + k shorter runs, level by level.
    """
    n = F.size("tokens")
    differ = _differing(n, similarity)

    def runs(size, parts) -> Column:
        """The hashes of `parts` runs of the tokens behind the leading ones."""
        at = lambda i: (DEPTH + F.floor(i * (size - DEPTH) / parts)).cast("int")
        return F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda i: F.xxhash64("leaf", parts, i, F.slice("tokens", at(i) + 1, at(i + 1) - at(i))))

    keyed = own.filter(differ > 0).select("v", n.alias("size"), F.explode(runs(n, differ + 1)).alias("key"))

    def split(rows: DataFrame, level: int) -> DataFrame | None:
        """The crowded lines under combinations of `level` runs.

        Lines with fewer places than runs agree in all but d places once they share a key of fewer runs, so all pairs hold
        there and no such group has two components.
        """
        if level > FURTHER:
            return None
        lines = rows.select("v", "root").distinct().join(own, "v").filter(n - DEPTH >= differ + level)
        chosen = F.transform(runs(n, differ + level), lambda k, i: F.struct(i.alias("i"), k.alias("k")))
        combined = lines.select("v", "root", n.alias("size"), chosen.alias("runs"), F.array(F.struct(F.lit(-1).alias("i"), F.xxhash64(F.lit("combination"), "leaf", F.lit(level)).alias("k"))).alias("key"))
        key = F.col("key")
        for _ in range(level):  # one run more, behind the last one
            key = F.flatten(F.transform(key, lambda c: F.transform(F.filter(F.col("runs"), lambda r: r["i"] > c["i"]), lambda r: F.struct(r["i"].alias("i"), F.xxhash64(c["k"], r["k"]).alias("k")))))
        return combined.select("v", "size", "root", F.explode(F.transform(key, lambda c: c["k"])).alias("key"))

    def verify(edges: DataFrame) -> DataFrame:
        x, y = (own.select(F.col("v").alias(c), F.col("leaf").alias(f"l{c}"), F.col("tokens").alias(f"t{c}")) for c in "ab")
        matched = F.aggregate(F.zip_with("ta", "tb", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, e: s + e)
        return edges.join(x, "a").join(y, "b").filter((F.col("la") == F.col("lb")) & (matched >= similarity * F.size("ta") - 1e-9)).select("a", "b")

    roots = similar_components(key_groups(keyed), verify, similarity, split)
    return roots.union(roots.select("root", "root").distinct()).toDF("v", "root")


def generalised(lines: DataFrame) -> DataFrame:
    """(template, tokens) of lines (template, tokens): the tokens that more than half of the lines have, a variable field elsewhere."""
    places = lines.select("template", F.posexplode("tokens").alias("place", "token")).groupBy("template", "place", "token").agg(F.count("*").alias("c"))
    voted = places.groupBy("template", "place").agg(F.max_by("token", "c").alias("token"), F.max("c").alias("c"), F.sum("c").alias("n"))
    token = F.when(2 * F.col("c") > F.col("n"), F.col("token"))  # null: a variable field
    ordered = voted.groupBy("template").agg(F.sort_array(F.collect_list(F.struct("place", token.alias("token")))).alias("x"), F.max("n").alias("lines"))  # as long as a line
    return ordered.select("template", F.transform("x", lambda x: x["token"]).alias("fixed"), "lines")


def leaf_templates(lines: DataFrame, similarity: float) -> DataFrame:
    """(leaf, h1, h2, tokens, template) of lines (leaf, h1, h2, tokens): those that belong to a generalised template.

    Linked lines propose a template, the tokens that more than half of them have. A line belongs to it if it agrees with
    its fixed tokens in `similarity` of all its places; a chain of lines without so much in common is no template. Lines
    that are left beside a template's members propose again, until no template finds members; ROUNDS times at most.
    """
    spark, left, found = lines.sparkSession, written(lines.withColumn("v", F.monotonically_increasing_id()), "leaf-lines"), None
    for k in range(ROUNDS):
        roots = written(linked_lines(left, similarity), "linked")
        grouped = written(left.join(roots, "v").withColumnRenamed("root", "template"), "proposing")
        proposed = written(generalised(grouped), "generalised")
        agreed = F.aggregate(F.zip_with("tokens", "fixed", lambda t, f: F.coalesce(t == f, F.lit(False)).cast("int")), F.lit(0), lambda s, e: s + e)
        told = written(join_hot(grouped, proposed, ["template"], "lines", grouped.count()).withColumn("member", agreed >= similarity * F.size("tokens") - 1e-9), "told")
        members = told.filter("member").select("leaf", "h1", "h2", "tokens", F.xxhash64(F.lit("template"), F.lit(k), "template").alias("template"))
        found = members if found is None else found.unionByName(members)
        counts = told.groupBy("template").agg(F.count_if("member").alias("n"), F.count("*").alias("lines")).filter("n > 0 and n < lines").select("template", "lines")
        left = written(join_hot(told.filter("not member").drop("fixed", "member"), counts, ["template"], "lines", told.count()).drop("template"), "left-lines")
        if left.isEmpty():
            break
    return found


def line_templates(cut: DataFrame, lines: DataFrame, similarity: float = 0.8) -> DataFrame:
    """leaf_templates of all lines: cut has their masked texts, lines the rest."""
    wide = _differing(F.col("n"), similarity) > 0
    ends = [f(F.struct("h1", "h2")).alias(c) for f, c in ((F.min, "a"), (F.max, "b"))]
    leaves = written(lines.filter(wide).groupBy("leaf").agg(*ends).filter("a <> b").select("leaf"), "leaves")
    inside = cut.join(small(leaves), "leaf", "left_semi").filter(wide)
    distinct = inside.groupBy("leaf", "h1", "h2").agg(F.first("masked").alias("masked")).select("leaf", "h1", "h2", F.split("masked", " ").alias("tokens"))
    return written(leaf_templates(distinct, similarity), "templates")


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_tokens: int = 3, long_tokens: int = 8, short_docs: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, rh, drops): for each document with lines to drop their places; rh is the hash of its text. A written table."""
    with scratch(docs.sparkSession):
        # written with their texts, so that documents are cut once; where texts aren't needed they aren't read
        lines = written(exploded(docs, id_col, text_col).filter(F.col("n") >= min_tokens), "lines")
        general = small(line_templates(lines, lines, similarity).select("h1", "h2", "template"))
        t, u = F.coalesce("template", "h1").alias("t"), F.when(F.col("template").isNull(), F.col("h2")).otherwise(0).alias("u")
        placed = lines.join(general, ["h1", "h2"], "left").select("id", "rh", "pos", "n", t, u)
        per_doc = placed.groupBy("t", "u", "id", "rh").agg(F.max("n").alias("n"))
        counted = per_doc.groupBy("t", "u").agg(F.count("*").alias("docs"), F.min(F.struct("id", "rh")).alias("first"), F.max("n").alias("n"))
        enough = F.when(F.col("n") >= long_tokens, F.col("docs") >= 2).otherwise(F.col("docs") >= short_docs)
        recurring = written(counted.filter(enough).select("t", "u", "docs", "first"), "recurring-templates")
        told = join_hot(placed, recurring, ["t", "u"], "docs", lines.count(), HOT_LINES)
        dropped = told.filter(~F.struct("id", "rh").eqNullSafe(F.col("first")))
        return written(dropped.groupBy("id", "rh").agg(F.collect_set("pos").alias("drops")), "drops", keep=True)


def without_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_lines: str | None = None, n_dropped: str | None = None, **parameters) -> DataFrame:
    """docs with the lines left; with n_lines and n_dropped, columns of these names count lines before and dropped."""
    own_hash, own_id, rh, gone = fresh(docs, "hash", "own_id", "rh", "drops")
    drops = recurring_lines(docs, id_col, text_col, **parameters).select(F.col("id").alias(own_id), F.col("rh").alias(rh), F.col("drops").alias(gone))
    own = docs.withColumn(own_hash, F.xxhash64(whole_text(text_col)))
    joined = own.join(drops, (F.col(own_hash) == F.col(rh)) & named(id_col).eqNullSafe(F.col(own_id)), "left")
    places = lambda ls: F.transform(ls, lambda x, i: i)
    kept = let(F.split(named(text_col), "\n"), lambda ls: F.array_join(F.transform(F.array_except(places(ls), F.col(gone)), lambda i: F.get(ls, i)), "\n"))
    text = F.when(F.col(gone).isNull(), named(text_col)).otherwise(kept)
    more = []
    if n_lines:
        more.append(F.size(F.split(whole_text(text_col), "\n")).alias(n_lines))
    if n_dropped:
        more.append(F.coalesce(F.size(gone), F.lit(0)).alias(n_dropped))
    return joined.select(*(text.alias(c) if c == text_col else named(c) for c in docs.columns), *more)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines that stay, and how many it had and lost."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_recurring_lines(docs, n_lines="n_lines", n_dropped="n_dropped")
