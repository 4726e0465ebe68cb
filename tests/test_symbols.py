from pyspark.sql import functions as F

from repoatlas.functions import cpp_text
from repoatlas.operators import symbols
from repoatlas.operators.includes import extract_includes
from repoatlas.operators.structures import file_structures, structure_text

SOURCE = r'''#pragma once
#include <vector> // not "this.h"
#include "a/b.h" /* over
two lines */
  #  include MACRO(x)
// class Fake { "open
/* struct No { */ const char* s = "class { ; } \" // no"; char q='{'; auto r = R"x(class Y { )" )x";
class Fwd;
template <class T, typename U = std::vector<int>>
class Foo<T*> final : public Base<T>, private ns::B {
    int id() { return 1'000; }
public:
    Foo() : a_(1), b_{2}, c_{ 3 } { if (x) { y(); } }
    virtual const std::string& get(int a = 'c', const char* s = "x;{") const noexcept override { return x; }
    struct Line { int n() { return 1; } };
    friend bool operator==(const Foo& a, const Foo& b) { return true; }
    template <typename V> V* conv(V v) { return nullptr; }
    ~Foo() = default;
    Foo(const Foo&) = delete;
    enum class E : int { A, B };
    int decl(struct timeval* tv);
protected:
    void slot() { auto l = [](int a) { return a; }; for (int i = 0; i < f(i); i++) { } }
};
extern "C" {
int cfun(void) { return 0; }
}
namespace a::b { namespace {
static inline std::map<int, std::function<void(int)>>
  *helper(int a,
          int b) { return 1; }
} }
int& A<T>::operator[](int i) const { return 1; }
A::~A() { }
A::B::B(int x)
  : x_(x) { }
struct { int u() { return 1; } } anon;
union U { int m() { return 2; } };
auto tr() -> std::vector<int> { return {}; }
TEST(Foo, Bar) { MACRO(x) { } }
class O { void f() { struct L { void g() {} }; } struct In { void h() {} public: int j; private: void k() {} }; void z() {} };
int open() { if (x) {
'''


def _files(spark, source, path="src/a.cpp"):
    return spark.createDataFrame(
        [("r", path, bytearray(source.encode()))], "repo string, path string, content binary"
    )


def test_segments_lose_nothing(spark):
    """Without marks, hidden literals put back, segments are the text without comments."""
    cases = {
        SOURCE: None,
        "'unclosed \" /* x": "'unclosed \"  ",
        "": "",
        "a/* b\n\n */c // d\n#define X \\\n y\nint i = 1'000'0; L\"x\\\n{y\" u8R\"(\n//)\" 'R'":
            "a c \n\nint i = 1'000'0; L\"x\\\n{y\" u8R\"(\n//)\" 'R'",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    for row in df.select("t", F.array_join(F.transform(cpp_text.segments(F.col("t")), cpp_text.shown), "").alias("s")).collect():
        if cases[row.t] is not None:
            assert row.s == cases[row.t]


def test_lines_after_long_comments_and_literals(spark):
    source = """int a() { /* one
two */ } int b() { } const char* s = R"x(
{ )x"; int c() { } const char* t = "k\\
l"; int d() { }
"""
    rows = symbols.functions_of(symbols.scopes(_files(spark, source))).orderBy("position").collect()
    assert [(r.name, r.line_start, r.line_end) for r in rows] == [
        ("a", 1, 2), ("b", 2, 2), ("c", 3, 3), ("d", 4, 4),
    ]


def test_long_literals_and_runs(spark):
    source = 'const char* s = "' + "x" * 200_000 + '"; /*' + "*" * 200_000 + "*/ int f() { }\n" + "a " * 200_000
    rows = symbols.functions_of(symbols.scopes(_files(spark, source))).collect()
    assert [(r.name, r.line_start) for r in rows] == [("f", 1)]


def test_includes(spark):
    rows = extract_includes(_files(spark, SOURCE)).orderBy("ordinal").collect()
    assert [(r.name, r.is_system) for r in rows] == [
        ("vector", True), ("a/b.h", False), ("MACRO(x)", False),
    ]


def _rows(spark, record):
    found = symbols.symbol_rows(_files(spark, SOURCE)).where(F.col("record") == record)
    return found.orderBy("position", "class_id").collect()


def test_classes(spark):
    assert [(r.kind, r.name, r.line_start, r.line_end) for r in _rows(spark, "class")] == [
        ("class", "Fwd", 8, 8),
        ("class", "Foo<T*>", 10, 24),
        ("struct", "Line", 15, 15),
        ("struct", "timeval", 21, 21),
        ("class", "O", 41, 41),
        ("struct", "L", 41, 41),
        ("struct", "In", 41, 41),
    ]


def test_methods(spark):
    rows = symbols.methods_of(symbols.scopes(_files(spark, SOURCE))).orderBy("position", "owner_name")
    got = [(r.owner_name, r.name, r.visibility) for r in rows.collect()]
    assert got == [
        ("Foo<T*>", "id", "private"),
        ("Foo<T*>", "Foo", "public"),
        ("Foo<T*>", "get", "public"),
        ("Foo<T*>", "n", "public"),
        ("Line", "n", "public"),
        ("Foo<T*>", "conv", "public"),
        ("Foo<T*>", "Foo", "public"),
        ("Foo<T*>", "Foo", "public"),
        ("Foo<T*>", "slot", "protected"),
        ("O", "f", "private"),
        ("L", "g", "public"),
        ("In", "h", "public"),
        ("O", "h", "private"),
        ("In", "k", "private"),
        ("O", "k", "private"),
        ("O", "z", "private"),
    ]


def test_functions(spark):
    got = [
        (r.name, " ".join(r.signature.split()), r.line_start, r.line_end, r.visibility)
        for r in _rows(spark, "function")
    ]
    assert got == [
        ("cfun", "int cfun(void)", 26, 26, "public"),
        ("helper", "std::map<int, std::function<void(int)>> *helper(int a, int b)", 29, 31, "private"),
        ("operator[]", "int & A<T>::operator[](int i) const", 33, 33, "public"),
        ("~A", "A::~A()", 34, 34, "public"),
        ("B::B", "A::B::B(int x)", 35, 36, "public"),
        ("m", "int m()", 38, 38, "public"),
        ("tr", "auto tr() -> std::vector<int>", 39, 39, "public"),
        ("TEST", "TEST(Foo, Bar)", 40, 40, "public"),
        ("open", "int open()", 42, 42, "public"),
    ]


def test_literals_come_back_in_signatures(spark):
    get = [r for r in _rows(spark, "method") if r.name == "get"][0]
    assert get.signature == (
        "std::string & get(int a = 'c', const char* s = \"x;{\") const noexcept override"
    )


def test_unbalanced_files_are_reported_and_kept(spark):
    rows = symbols.extraction_skips(_files(spark, SOURCE)).collect()
    assert [(r.path, r.reason) for r in rows] == [("src/a.cpp", "unbalanced")]
    unreadable = spark.createDataFrame([("r", "x.h", None)], "repo string, path string, content binary")
    assert symbols.extraction_skips(unreadable).first().reason == "unreadable"


def test_structure_text(spark):
    source = """#include <a>
#include "b.h"
class C {
    void p1() {}
    void p2() {}
public:
    int go(int x) { return x; }
protected:
    void q() {}
};
static void s() {}
"""
    row = file_structures(_files(spark, source)).select(structure_text().alias("t")).first()
    assert row.t == """
### a.cpp

Dependencies:
  System (1): a
  Local (1): b.h

Classes/Structs:
  **C** (lines 3-10)
    Public API:
      - int go(int x)
    Internal (3 total): q, p1, p2

Internal Functions:
    Internal (1 total): s"""


def test_one_exchange_for_all_symbols(spark):
    plan = symbols.symbol_rows(_files(spark, SOURCE))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_brackets_nest_to_any_depth(spark):
    deep = "(" * 12 + "1" + ")" * 12
    angle = "A<" * 9 + "int" + ">" * 9
    source = (
        f"int f(int a = {deep}, int b = (2) + ((3))) {{ return a; }}\n"
        f"{angle} g({angle} x) {{ return x; }}\n"
        f"template <> struct B<{angle}> {{ int m() {{ return 1; }} }};\n"
    )
    row = file_structures(_files(spark, source)).first()
    assert [(x.name, x.signature) for x in row.functions] == [
        ("f", f"int f(int a = {deep}, int b = (2) + ((3)))"),
        ("g", f"{angle} g({angle} x)"),
    ]
    assert [(c.name, [m.name for m in c.methods]) for c in row.classes] == [(f"B<{angle}>", ["m"])]


def test_many_brackets_in_one_segment_take_linear_time(spark):
    import time

    def seconds(source):
        start = time.perf_counter()
        rows = symbols.functions_of(symbols.scopes(_files(spark, source))).collect()
        return time.perf_counter() - start, [(r.name, r.line_start) for r in rows]

    flat = ", ".join(f"f({i})" for i in range(16_000))
    few, _ = min(seconds("int f(int a = ((((((((((1)))))))))) { }") for _ in range(2))
    for source, found in (
        (f"int g(int a = h({flat})) {{ return 1; }}\n", [("g", 1)]),
        (f"int x[] = {{ {flat} }};\nint last() {{ return 1; }}\n", [("last", 2)]),
    ):
        took, rows = seconds(source)
        assert rows == found
        assert took < few + 2


HALVES = """#ifndef GUARD
#define GUARD
#if defined(A) && \\
    defined(B)
void p() {
#else // not B
void q() {
#endif
  int x;
}
int after() { return 1; }
class K {
#ifdef WIDE
  int wide() { return 1; }
#elif NARROW
  int narrow() { return 2; }
#else
  int other() { return 3; }
#endif
  const char* s() { return "#else {"; } // #else {
 public:
  void m() {
#if X
    if (a) {
#  if Y
      while (b) {
#  else
      {
#  endif
      }
#elif Z
    if (c) {
#else
    {
#endif
    }
  }
#ifdef T
  int t() { if (x) { return 1;
#ifdef U
    } else if (y) {
#else
    } else {
#endif
    return 2; } }
#endif
};
#if ONE
struct S : A {
#else
struct S : B {
#endif
  int in() { return 0; }
};
#endif
#else
#endif
int last() { return 9; }
"""


def test_halves_that_open_braces_count_once(spark):
    """The first half pairs braces where halves leave some open; whole halves all stay."""
    scoped = symbols.scopes(_files(spark, HALVES))
    classes = symbols.classes_of(scoped).orderBy("line_start").collect()
    assert [(c.name, c.line_start, c.line_end) for c in classes] == [("K", 12, 47), ("S", 49, 54)]
    methods = symbols.methods_of(scoped).orderBy("line_start").collect()
    assert [(m.name, m.line_start, m.line_end, m.visibility) for m in methods] == [
        ("wide", 14, 14, "private"), ("narrow", 16, 16, "private"), ("other", 18, 18, "private"),
        ("s", 20, 20, "private"), ("m", 22, 37, "public"), ("t", 39, 45, "public"), ("in", 53, 53, "public"),
    ]
    functions = symbols.functions_of(scoped).orderBy("line_start").collect()
    assert [(f.name, f.line_start, f.line_end) for f in functions] == [
        ("p", 5, 10), ("after", 11, 11), ("last", 58, 58),
    ]


def test_many_halves_take_time_in_proportion(spark):
    part = "#if A\nint f%d() {\n#else\nint g%d() {\n#endif\n}\n"
    source = "".join(part % (n, n) for n in range(2_000))
    functions = symbols.functions_of(symbols.scopes(_files(spark, source)))
    assert functions.count() == 2_000
    assert functions.where("name not like 'f%' or line_end - line_start <> 4").isEmpty()


def test_ends_of_plain_blocks_leave_before_scopes_are_looked_up(spark):
    source = "class A { int f() { if (x) { } } };\nnamespace { int g() { } }\nint h() { for (;;) { } }\n"
    files = _files(spark, source)
    ends = symbols._with_scopes(symbols.file_segments(files)).where("delim = '}'").collect()
    assert sorted(r.closes for r in ends) == ["class", "unnamed_namespace"]
    found = symbols.functions_of(symbols.scopes(files)).orderBy("position").collect()
    assert [(r.name, r.line_end, r.visibility) for r in found] == [("g", 2, "private"), ("h", 3, "public")]


def test_labels_and_braces_on_one_line(spark):
    text = "class A { public: int a; private : int b() { return x ? 1 : 2; } };\n\npublic int c;\n"
    df = spark.createDataFrame([(text,)], "t string")
    cut = df.select(F.transform(cpp_text.segments(F.col("t")), cpp_text.shown).alias("s")).first().s
    assert cut == [
        "class A {", " public:", " int a;", " private :", " int b() {", " return x ? 1 : 2;", " }", " }", ";",
        "\n\npublic int c;", "\n",
    ]
