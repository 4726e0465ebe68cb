"""Source trees derived from the given tables.

Three corpora in the shape of ``source_files``: prose files from ``documents``, web
pages from ``pages``, and C++ sources rendered from the star schema, whose facts are
known from the keys. Prior snapshots are derived the same way.
"""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoatlas.functions import globs, paths, text
from repoatlas.operators import changes, modules
from repoatlas.settings import DEFAULT_EXCLUDE
from repoatlas.sources.workspace import stored

# Rules and depth of the rendered C++ corpus.
STAR_INCLUDE = ("**/*.cpp", "**/*.h")
STAR_DEPTH = 3
# The saved snapshot shows the tables as they were on this day.
SNAPSHOT_DAY = "1999-01-01"
SAVED_AT = "2024-01-01 00:00:00"
RUN_TS = "2024-06-01 12:30:45"

NATION_HEADER = """#pragma once
// @name
struct Nation_@n {
    int region() const { return @r; }
};
"""
SUPPLIER_HEADER = """#pragma once
#include <string>
#include "../../include/nation/nation_@n.h"
class Supplier_@s {
public:
    explicit Supplier_@s(int key) : key_(key) {}
    int nation() const { return @n; }
private:
    int key_;
};
"""
PART_HEADER = """#pragma once
#include <vector>
namespace parts {
inline int size_@p() { return @z; }
}  // namespace parts
"""
ORDER_HEAD = """// class Fake_@o { not code }
const char* label_@o = "class { ; } \\" // no";
class Fwd_@o;
class Order_@o {
    int id() { return @o; }
public:
    int cust() const { return @c; }
"""
ORDER_NESTED = """    struct Line {
        int n() { return @d; }
    };
"""
ORDER_TAIL = """protected:
    virtual int prio() { if (id() > 0) { return @d; } return 0; }
    int decl_only();
};
static int helper_@o() {
    return 1;
}
namespace {
int hidden_@o() { return 2; }
}
int Order_@o::decl_only() {
    return 3;
}
"""
NESTED_TEST = "int test_@o() { return 0; }\n"
TOP_TEST = "int broken_@o() {\n    return 1;\n"
COMPLETION = """# Module: @m

**Purpose**: Handles @m
**Consumes**: keys of @m
**Produces**: rows of @m
"""
LOOKALIKE_HEADER = "struct Nation_@n;\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fill(template: str, **values):
    """The template with a value at each ``@name``; null if one of its values is."""
    names = "|".join(sorted(values, key=len, reverse=True))
    pieces = re.split(f"@({names})", template)
    cells = [values[p].cast("string") if n % 2 else F.lit(p) for n, p in enumerate(pieces)]
    # A value that the template has no place for makes it null as well.
    unused = [v.isNotNull() for k, v in values.items() if k not in pieces[1::2]]
    filled = F.concat(*cells)
    return F.when(reduce(Column.__and__, unused), filled) if unused else filled


def _files(df: DataFrame, repo, path, body, mtime) -> DataFrame:
    content = body.cast("binary")
    return df.select(
        repo.alias("repo"),
        path.alias("path"),
        content.alias("content"),
        F.octet_length(content).cast("long").alias("size"),
        mtime.cast("timestamp").alias("mtime"),
    )


def documents_path():
    doc = F.col("doc_id")
    suffix = F.element_at(
        F.array(*map(F.lit, ("h", "cpp", "HPP", "txt", "py"))), (doc % 5 + 1).cast("int")
    )
    return F.concat(
        F.lit("src/"), F.col("lang"), F.lit("/d"), doc % 10, F.lit("/doc_"), doc, F.lit("."), suffix
    )


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document; the document's source is the repository."""
    docs = table(spark, sf_dir, "documents")
    return _files(docs, F.col("source"), documents_path(), F.col("text"), F.lit(SAVED_AT))


def documents_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved files of the prose corpus: labelled documents, with another hash where the
    label says low quality."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    path = documents_path()
    content = F.when(F.col("quality") == 0, F.concat(F.lit("old "), F.col("text"))).otherwise(
        F.col("text")
    )
    return docs.join(labels, "doc_id").select(
        F.col("source").alias("repo"),
        path.alias("path"),
        text.content_hash(content.cast("binary")).alias("file_hash"),
        paths.module_name(path).alias("module"),
    )


def documents_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own path rules of the repositories that hold toxic documents."""
    docs = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels").where(F.col("toxic") == 1), "doc_id"
    )
    include = docs.select(
        F.col("source").alias("repo"),
        F.lit("include").alias("kind"),
        F.concat(F.lit("src/"), F.col("lang"), F.lit("/**")).alias("pattern"),
    )
    exclude = docs.where(F.col("lang") == "en").select(
        F.col("source").alias("repo"),
        F.lit("exclude").alias("kind"),
        F.concat(F.lit("*/d"), F.col("doc_id") % 10, F.lit("/doc_*[0-4].?")).alias("pattern"),
    )
    return include.unionByName(exclude).distinct()


def pages_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per page: the host is the repository, the URL path the file path."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/?([^?#]*)", 1)
    return _files(pages, host, path, F.col("html"), F.lit(SAVED_AT))


def _order_lists(spark: SparkSession, sf_dir: str, day: str | None) -> DataFrame:
    """Orders with the parts and suppliers of their lines: what an order's files are made of.

    Narrow and stored: files are rendered where they are read, row by row, so a reader of paths
    renders no content and no content is written.
    """
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"
    )
    if day:
        orders = orders.where(F.col("o_orderdate") < F.lit(day).cast("timestamp"))
        lines = lines.where(F.col("l_shipdate") < F.lit(day).cast("timestamp"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_type").alias("type"))
    lists = (
        lines.join(part, lines["l_partkey"] == part["p_partkey"])
        .groupBy("l_orderkey")
        .agg(
            F.sort_array(F.collect_set(F.struct("l_partkey", "type"))).alias("parts"),
            F.sort_array(F.collect_set("l_suppkey")).alias("supps"),
        )
    )
    return orders.join(lists, orders["o_orderkey"] == lists["l_orderkey"], "left").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_orderdate",
        F.substring("o_orderpriority", 1, 1).alias("digit"),
        F.col("l_orderkey").isNotNull().alias("has_lines"),
        "parts",
        "supps",
    )


def _order_files(spark: SparkSession, sf_dir: str, day: str | None) -> DataFrame:
    rows = stored(
        spark, ("star_orders", sf_dir, day), lambda: _order_lists(spark, sf_dir, day), shuffled=False
    )
    o, digit, status = F.col("o_orderkey"), F.col("digit"), F.col("o_orderstatus")

    def lines(items, *parts):
        joined = F.transform(items, lambda i: F.concat(*(p(i) if callable(p) else F.lit(p) for p in parts)))
        return F.coalesce(F.array_join(joined, ""), F.lit(""))

    includes = F.concat(
        F.lit("#include <vector>\n"),
        lines(
            "parts",
            '#include "src/part/',
            lambda p: p["type"],
            "/part_",
            lambda p: p["l_partkey"].cast("string"),
            '.h"\n',
        ),
        lines("supps", '#include "../../supplier/supp_', lambda s: s.cast("string"), '.h"\n'),
        F.when(status == "P", F.concat(F.lit('#include "missing_'), o, F.lit('.h"\n'))).otherwise(""),
        F.when(status == "F", F.lit('#include "../../../../outside.h"\n')).otherwise(""),
        F.when(
            digit == "1", F.concat(F.lit('#include "../../gone/cust_'), F.col("o_custkey"), F.lit('.h"\n'))
        ).otherwise(""),
    )
    fields = {"o": o, "c": F.col("o_custkey"), "d": digit}
    body = F.concat(
        includes,
        _fill(ORDER_HEAD, **fields),
        F.when(status == "O", _fill(ORDER_NESTED, **fields)).otherwise(""),
        _fill(ORDER_TAIL, **fields),
    )
    name = F.concat(F.lit("order_"), o)

    def files(chosen, path, body):
        return _files(chosen, F.lit("star"), path, body, F.col("o_orderdate"))

    own = files(rows, F.concat(F.lit("src/orders/p"), digit, F.lit("/"), name, F.lit(".cpp")), body)
    nested = files(
        rows.where(status == "P"),
        F.concat(F.lit("src/test/"), name, F.lit("_test.cpp")),
        _fill(NESTED_TEST, o=o),
    )
    top = files(
        rows.where(~F.col("has_lines")),
        F.concat(F.lit("test/"), name, F.lit("_test.cpp")),
        _fill(TOP_TEST, o=o),
    )
    return own.unionByName(nested).unionByName(top)


def star_corpus(spark: SparkSession, sf_dir: str, day: str | None = None) -> DataFrame:
    """C++ sources rendered from the star schema, all of it or as it was on a day."""
    nation = table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier")
    part = table(spark, sf_dir, "part")
    if day:
        supplier = supplier.where(F.col("s_acctbal") >= 0)
    repo, saved = F.lit("star"), F.lit(SAVED_AT)
    n, s, p = F.col("n_nationkey"), F.col("s_suppkey"), F.col("p_partkey")
    headers = [
        _files(
            nation,
            repo,
            F.concat(F.lit("include/nation/nation_"), n, F.lit(".h")),
            _fill(NATION_HEADER, name=F.col("n_name"), n=n, r=F.col("n_regionkey")),
            saved,
        ),
        _files(
            nation,
            repo,
            F.concat(F.lit("srcx/nation_"), n, F.lit(".h")),
            _fill(LOOKALIKE_HEADER, n=n),
            saved,
        ),
        _files(
            supplier,
            repo,
            F.concat(F.lit("src/supplier/supp_"), s, F.lit(".h")),
            _fill(SUPPLIER_HEADER, n=F.col("s_nationkey"), s=s),
            saved,
        ),
        _files(
            part,
            repo,
            F.concat(F.lit("src/part/"), F.lower("p_type"), F.lit("/part_"), p, F.lit(".h")),
            _fill(PART_HEADER, p=p, z=F.col("p_size")),
            saved,
        ),
    ]
    out = _order_files(spark, sf_dir, day)
    for df in headers:
        out = out.unionByName(df)
    return out


def star_completions(prompts: DataFrame) -> DataFrame:
    """Stored answers to prompts: plain, in a markdown fence, in a bare fence with a
    second purpose line, or none, by the length of the module name."""
    module = F.col("module")
    plain = _fill(COMPLETION, m=module)
    shape = F.length(module) % 4
    fence = "```"
    return prompts.where(shape != 3).select(
        "repo",
        "prompt_hash",
        F.when(shape == 0, plain)
        .when(shape == 1, F.concat(F.lit(fence + "markdown\n"), plain, F.lit(fence)))
        .otherwise(F.concat(F.lit(fence + "\n**Purpose**: draft\n"), plain, F.lit("\n" + fence)))
        .alias("text"),
    )


def star_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved files of the C++ corpus: its snapshot, plus headers that are gone now."""
    old = star_corpus(spark, sf_dir, SNAPSHOT_DAY).where(
        globs.selected(F.col("path"), STAR_INCLUDE, DEFAULT_EXCLUDE)
    )
    saved = modules.assign_modules(changes.hash_files(old), depth=STAR_DEPTH).select(
        "repo", "path", "file_hash", "module"
    )
    gone = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "MACHINERY")
    c = F.col("c_custkey")
    return saved.unionByName(
        gone.select(
            F.lit("star").alias("repo"),
            F.concat(F.lit("src/gone/cust_"), c, F.lit(".h")).alias("path"),
            text.content_hash(c.cast("string").cast("binary")).alias("file_hash"),
            F.lit("src/gone").alias("module"),
        )
    )
