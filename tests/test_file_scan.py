"""Symbols found file by file against the same in expressions and windows."""

import random

from pyspark.sql import functions as F

from repoatlas.functions import cpp_scan, cpp_text
from repoatlas.operators import includes, symbols
from repoatlas.operators.structures import file_structures
from test_symbols import HALVES, SOURCE

WORDS = r'''class|struct|enum class|friend class|enum|union|namespace|extern "C"|template <class T>|static
virtual|const|int|void|A|B::C|D<T*>|E<F<G<H<int>>>>|operator()|operator==|~A|f|g|ns::h|public:|private :
protected:|public slots:|(int a)|(int a = f(1))|((((((((1))))))))|{|}|{}|;|{ 3 }|,|: a_(1), b_{2}|= default;
= delete;|noexcept|override|final|-> std::vector<int>|&|*|[[nodiscard]]|alignas(8)|requires (C<T>)|MACRO(x)
if (a)|else|for (;;)|try|return x;|typedef struct|"s { ; } \" x"|'{'|1'000|a'b|R"(raw {\n )"|u8R"(q)"
// c { class\n|// c \\\n d\n|/* b {\n\nclass Z { */|\n|\n|\n#define X { \\\n }\n|\n#if A\n|\n#else\n
\n# elif B\n|\n#endif\n|\n#include <a> // x\n|\n#include "b/c.h"\n|\n  #  include MAC /* x */\n|#|\\\n|\r\n|é
\x01|\x02|\x03|struct EXPORT|class EXPORT\n|struct A::B|class A : public B|class Fwd;|include|template'''
WORDS = [w.replace("\\n", "\n").replace("\\r", "\r").replace("\\x01", "\x01").replace("\\x02", "\x02")
         .replace("\\x03", "\x03").replace("\\\\", "\\") for w in WORDS.replace("\n", "|").split("|")]


def _texts():
    pick = random.Random(7)
    texts = [SOURCE, HALVES, "", "int f() { return 1; }"]
    for _ in range(150):
        texts.append(pick.choice(["", " ", "\n"]).join(pick.choices(WORDS, k=pick.choice([3, 20, 80]))))
    return texts


def _files(spark):
    rows = [("r", f"f{i}", t.encode()) for i, t in enumerate(_texts())]
    # Texts under one path, without a path or a repository, without content, and not UTF-8.
    rows += [("r", "twice", SOURCE.encode())] * 2 + [("r", "thrice", HALVES.encode())] * 3
    rows += [("r", None, b"class A { int f() { } };"), (None, "x", b"int g() { }")]
    rows += [("r", "none", None), ("r", "bad", b"int f\xff\xe2\x82() { }\n")]
    return spark.createDataFrame(rows, "repo string, path string, content binary")


def _sorted(df):
    return sorted(map(str, df.collect()))


def test_files_declare_what_their_segments_do(spark):
    files = _files(spark)
    by_segment = symbols.records_of(symbols.file_segments(files)).drop("head")
    found = _sorted(symbols.symbol_rows(files))
    assert len(found) > 400
    assert found == _sorted(by_segment)
    methods = symbols.methods_of(symbols.scopes(files))
    assert _sorted(methods.select("repo", "path", F.col("owner_class_id").alias("class_id"), "position", "name")) == _sorted(
        by_segment.where("record = 'method'").select("repo", "path", "class_id", "position", "name")
    )


def test_includes_of_a_text_alone(spark):
    files = _files(spark).where("path like 'f%'")
    rows = includes.extract_includes(files).collect()
    texts = {f"f{i}": t for i, t in enumerate(_texts())}
    ours = [(p, n, *i) for p, t in texts.items() for n, i in enumerate(cpp_scan.include_names(cpp_scan.plain(t)))]
    assert sorted((r.path, r.ordinal, r.name, r.is_system) for r in rows) == sorted(ours)


def test_symbols_need_one_exchange_and_no_window(spark):
    files = _files(spark)
    for df in (symbols.methods_of(symbols.scopes(files)), symbols.symbol_rows(files), file_structures(files)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Window" not in plan and "Aggregate" not in plan


def test_raw_strings_without_an_end_take_no_longer(spark):
    """The lines behind one were tried in every way that they could be cut."""
    source = "int f() { }\nauto s = R\"(\n" + "x\n" * 60 + ";\nint g() { }\n"
    assert [r[4] for r in cpp_scan.file_rows(source)[0] if r[2] == "function"] == ["f", "g"]
    df = spark.createDataFrame([(source,)], "t string").select(F.size(cpp_text.segments(F.col("t"))).alias("n"))
    assert df.first().n == 6
