"""DuckDB SQL for every query.

Facts about the C++ corpus come from the keys of the star schema, not from reading the
rendered text. Shared parts are named CTEs; ``_sql`` adds those a query mentions.
"""

import re

from repoatlas import TOOL_NAME, __version__
from repoatlas.operators.documents import OVERVIEW_HEAD, PROMPT_HEAD
from repoatlas.plans.queries import GLOB_PATTERNS
from repoatlas.sources import corpora as c

_NL = "chr(10)"


def _lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _fill(template: str, **values) -> str:
    out = _lit(template)
    for name, value in values.items():
        out = f"replace({out}, '@{name}', ({value})::VARCHAR)"
    return out


def _module(path: str, depth: int) -> str:
    parts = f"string_split({path}, '/')"
    return (
        f"CASE WHEN len({parts}) > {depth} THEN array_to_string({parts}[1:{depth}], '/') "
        f"WHEN len({parts}) > 1 THEN array_to_string({parts}[1:len({parts}) - 1], '/') "
        "ELSE 'root' END"
    )


def _parent(path: str, root: str) -> str:
    return f"CASE WHEN contains({path}, '/') THEN regexp_replace({path}, '/[^/]*$', '') ELSE '{root}' END"


_BLANK = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{_BLANK}+', ''), '{_BLANK}+$', '')"


def _strip_fences(source: str, column: str, keep: str) -> str:
    """Three steps as nested selects over ``source``."""
    f = "'```'"
    one = (
        f"SELECT {keep}, CASE WHEN starts_with({column}, '```markdown') "
        f"THEN {_strip(f'substr({column}, 12)')} ELSE {column} END AS x FROM {source}"
    )
    two = f"SELECT {keep}, CASE WHEN starts_with(x, {f}) THEN {_strip('substr(x, 4)')} ELSE x END AS x FROM ({one})"
    return (
        f"SELECT {keep}, CASE WHEN ends_with(x, {f}) THEN {_strip('left(x, length(x) - 3)')} "
        f"ELSE x END AS x FROM ({two})"
    )


def _footer(ts: str, digest: str | None = None) -> str:
    parts = [f"'Generated: ' || strftime({ts}, '%Y-%m-%dT%H:%M:%S')"]
    if digest:
        parts.append(f"'Source hash: ' || left({digest}, 7)")
    parts.append(f"'{TOOL_NAME} v{__version__}'")
    return f"chr(10) || '---' || chr(10) || '*' || concat_ws(' | ', {', '.join(parts)}) || '*' || chr(10)"


_RUN = f"TIMESTAMP '{c.RUN_TS}'"
_STAMP = f"'{c.RUN_TS.replace(' ', 'T')}Z'"
_DOC_PATH = (
    "'src/' || lang || '/d' || (doc_id % 10) || '/doc_' || doc_id || '.' || "
    "['h', 'cpp', 'HPP', 'txt', 'py'][(doc_id % 5 + 1)::INT]"
)
_SELECTED = (
    "NOT (path LIKE '%/test/%' OR path LIKE '%/tests/%' OR path LIKE '%/vendor/%' "
    "OR path LIKE '%/third#_party/%' ESCAPE '#' OR path LIKE '%/build/%')"
)
_STAR_KEPT = _SELECTED + " AND (path LIKE '%.cpp' OR path LIKE '%.h')"

CTES = {
    # prose corpus
    "prose": f"SELECT source AS repo, {_DOC_PATH} AS path, text AS content, doc_id, lang FROM documents",
    "prose_hash": (
        "SELECT repo, path, 'sha256:' || sha256(content) AS file_hash, "
        f"{_module('path', 2)} AS module, doc_id FROM prose"
    ),
    "prose_state": (
        "SELECT repo, path, 'sha256:' || sha256(CASE WHEN q = 0 THEN 'old ' || content ELSE content END) "
        f"AS file_hash, {_module('path', 2)} AS module FROM prose "
        "JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id)"
    ),
    "prose_changed": (
        "SELECT h.* FROM prose_hash h LEFT JOIN prose_state s USING (repo, path) "
        "WHERE s.file_hash IS NULL OR s.file_hash <> h.file_hash"
    ),
    "own_rules": (
        "SELECT DISTINCT source AS repo, 'include' AS kind, 'src/' || lang || '/**' AS pattern, "
        "lang, NULL::BIGINT AS d FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 UNION "
        "SELECT DISTINCT source, 'exclude', '*/d' || (doc_id % 10) || '/doc_*[0-4].?', NULL, doc_id % 10 "
        "FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND lang = 'en'"
    ),
    # star corpus, as it is
    "ord": (
        "SELECT o_orderkey AS o, o_custkey AS c, o_orderstatus AS st, left(o_orderpriority, 1) AS d "
        "FROM orders"
    ),
    "inc": "{inc:ord:lineitem}",
    "star_all": "{files:ord:inc:lineitem:supplier}",
    "star": f"SELECT * FROM star_all WHERE {_STAR_KEPT}",
    "star_hash": (
        f"SELECT path, 'sha256:' || sha256(content) AS file_hash, {_module('path', 3)} AS module FROM star"
    ),
    # star corpus, as it was
    "ord_old": (
        "SELECT o_orderkey AS o, o_custkey AS c, o_orderstatus AS st, left(o_orderpriority, 1) AS d "
        f"FROM orders WHERE o_orderdate < TIMESTAMP '{c.SNAPSHOT_DAY}'"
    ),
    "line_old": f"SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{c.SNAPSHOT_DAY}'",
    "supp_old": "SELECT * FROM supplier WHERE s_acctbal >= 0",
    "inc_old": "{inc:ord_old:line_old}",
    "star_all_old": "{files:ord_old:inc_old:line_old:supp_old}",
    "star_state": (
        f"SELECT path, 'sha256:' || sha256(content) AS file_hash, {_module('path', 3)} AS module "
        f"FROM star_all_old WHERE {_STAR_KEPT} UNION ALL "
        "SELECT 'src/gone/cust_' || c_custkey || '.h', 'sha256:' || sha256(c_custkey::VARCHAR), 'src/gone' "
        "FROM customer WHERE c_mktsegment = 'MACHINERY'"
    ),
    "star_changed": (
        "SELECT h.* FROM star_hash h LEFT JOIN star_state s USING (path) "
        "WHERE s.file_hash IS NULL OR s.file_hash <> h.file_hash"
    ),
    # facts from the keys
    "imp": (
        "SELECT path_of(o, d) AS path, 'src/orders/p' || d AS module, ordinal, name, g = 0 AS is_system, "
        "CASE g WHEN 1 THEN 'src/orders/p' || d || '/' || name "
        "WHEN 2 THEN 'src/supplier/supp_' || k || '.h' "
        "WHEN 3 THEN 'src/orders/p' || d || '/' || name "
        "WHEN 5 THEN 'src/gone/cust_' || c || '.h' END AS normalized, "
        "CASE WHEN g = 1 THEN regexp_replace(name, '/[^/]*$', '') END AS exact_module, "
        "CASE WHEN g = 2 THEN 'src/supplier' WHEN g = 5 AND c_mktsegment = 'MACHINERY' THEN 'src/gone' END "
        "AS relative_module FROM inc JOIN ord USING (o) JOIN customer ON c = c_custkey "
        "UNION ALL SELECT 'src/supplier/supp_' || s_suppkey || '.h', 'src/supplier', 0, 'string', true, NULL, NULL, NULL FROM supplier "
        "UNION ALL SELECT 'src/supplier/supp_' || s_suppkey || '.h', 'src/supplier', 1, "
        "'../../include/nation/nation_' || s_nationkey || '.h', false, "
        "'include/nation/nation_' || s_nationkey || '.h', NULL, 'include/nation' FROM supplier "
        "UNION ALL SELECT 'src/part/' || lower(p_type) || '/part_' || p_partkey || '.h', "
        "'src/part/' || lower(p_type), 0, 'vector', true, NULL, NULL, NULL FROM part"
    ).replace("path_of(o, d)", "'src/orders/p' || d || '/order_' || o || '.cpp'"),
    "local": (
        "SELECT *, coalesce(exact_module, relative_module) AS target_module FROM imp WHERE NOT is_system"
    ),
    "edges": (
        "SELECT DISTINCT module AS src_module, target_module AS dst_module FROM local "
        "WHERE target_module IS NOT NULL AND target_module <> module"
    ),
    "run_modules": "SELECT DISTINCT module FROM star_hash",
    "sides": (
        "SELECT src_module AS module, 'depends_on' AS side, dst_module AS other FROM edges UNION ALL "
        "SELECT dst_module, 'depended_by', src_module FROM edges "
        "WHERE dst_module IN (SELECT module FROM run_modules)"
    ),
    "new_modules": "SELECT DISTINCT module FROM star_changed",
    "new_edges": (
        "SELECT DISTINCT module AS src_module, target_module AS dst_module FROM local "
        "WHERE path IN (SELECT path FROM star_changed) "
        "AND target_module IS NOT NULL AND target_module <> module"
    ),
    "new_sides": (
        "SELECT src_module AS module, 'depends_on' AS side, dst_module AS other FROM new_edges UNION ALL "
        "SELECT dst_module, 'depended_by', src_module FROM new_edges "
        "WHERE dst_module IN (SELECT module FROM new_modules)"
    ),
    # b: include lines of an order; t: lines before its tail
    "oline": (
        "SELECT o, d, st, 'src/orders/p' || d || '/order_' || o || '.cpp' AS path, b, "
        "b + 7 + CASE WHEN st = 'O' THEN 3 ELSE 0 END AS t "
        "FROM ord JOIN (SELECT o, count(*) AS b FROM inc GROUP BY o) USING (o)"
    ),
    "cls": (
        "SELECT path, 'class' AS kind, 'Fwd_' || o AS name, b + 3 AS line_start, b + 3 AS line_end FROM oline "
        "UNION ALL SELECT path, 'class', 'Order_' || o, b + 4, t + 4 FROM oline "
        "UNION ALL SELECT path, 'struct', 'Line', b + 8, b + 10 FROM oline WHERE st = 'O' "
        "UNION ALL SELECT 'include/nation/nation_' || n_nationkey || '.h', 'struct', 'Nation_' || n_nationkey, 3, 5 FROM nation "
        "UNION ALL SELECT 'srcx/nation_' || n_nationkey || '.h', 'struct', 'Nation_' || n_nationkey, 1, 1 FROM nation "
        "UNION ALL SELECT 'src/supplier/supp_' || s_suppkey || '.h', 'class', 'Supplier_' || s_suppkey, 4, 10 FROM supplier"
    ),
    "meth": (
        "SELECT path, 'Order_' || o AS owner_name, 1 AS pos, 'id' AS name, 'int id()' AS signature, "
        "b + 5 AS line_start, 'private' AS visibility, true AS is_own FROM oline "
        "UNION ALL SELECT path, 'Order_' || o, 2, 'cust', 'int cust() const', b + 7, 'public', true FROM oline "
        "UNION ALL SELECT path, 'Order_' || o, 3, 'n', 'int n()', b + 9, 'public', false FROM oline WHERE st = 'O' "
        "UNION ALL SELECT path, 'Line', 3, 'n', 'int n()', b + 9, 'public', true FROM oline WHERE st = 'O' "
        "UNION ALL SELECT path, 'Order_' || o, 4, 'prio', 'int prio()', t + 2, 'protected', true FROM oline "
        "UNION ALL SELECT 'include/nation/nation_' || n_nationkey || '.h', 'Nation_' || n_nationkey, 1, 'region', "
        "'int region() const', 4, 'public', true FROM nation "
        "UNION ALL SELECT 'src/supplier/supp_' || s_suppkey || '.h', 'Supplier_' || s_suppkey, 1, 'Supplier_' || s_suppkey, "
        "'Supplier_' || s_suppkey || '(int key)', 6, 'public', true FROM supplier "
        "UNION ALL SELECT 'src/supplier/supp_' || s_suppkey || '.h', 'Supplier_' || s_suppkey, 2, 'nation', "
        "'int nation() const', 7, 'public', true FROM supplier"
    ),
    "func": (
        "SELECT path, 5 AS pos, 'helper_' || o AS name, 'int helper_' || o || '()' AS signature, "
        "t + 5 AS line_start, t + 7 AS line_end, 'private' AS visibility, 'file' AS parent_kind FROM oline "
        "UNION ALL SELECT path, 6, 'hidden_' || o, 'int hidden_' || o || '()', t + 9, t + 9, 'private', 'unnamed_namespace' FROM oline "
        "UNION ALL SELECT path, 7, 'decl_only', 'int Order_' || o || '::decl_only()', t + 11, t + 13, 'public', 'file' FROM oline "
        "UNION ALL SELECT 'src/part/' || lower(p_type) || '/part_' || p_partkey || '.h', 1, 'size_' || p_partkey, "
        "'int size_' || p_partkey || '()', 4, 4, 'public', 'namespace' FROM part "
        "UNION ALL SELECT 'test/order_' || o || '_test.cpp', 1, 'broken_' || o, 'int broken_' || o || '()', 1, 2, 'public', 'file' "
        "FROM ord WHERE o NOT IN (SELECT l_orderkey FROM lineitem)"
    ),
    # text of a file's facts, per file family
    "includes_text": (
        "SELECT path, chr(10) || chr(10) || 'Dependencies:' || "
        "coalesce(chr(10) || '  System (' || count(*) FILTER (is_system) || '): ' || "
        "string_agg(name, ', ' ORDER BY ordinal) FILTER (is_system), '') || "
        "coalesce(chr(10) || '  Local (' || count(*) FILTER (NOT is_system) || '): ' || "
        "array_to_string((list(name ORDER BY ordinal) FILTER (NOT is_system))[1:10], ', ') || "
        "CASE WHEN count(*) FILTER (NOT is_system) > 10 THEN '...' ELSE '' END, '') AS includes FROM imp GROUP BY path"
    ),
    "blocks": (
        "SELECT h.path, h.module, chr(10) || '### ' || regexp_extract(h.path, '[^/]+$') || coalesce(includes, '') || "
        "coalesce(facts, '') AS block FROM star_hash h LEFT JOIN includes_text USING (path) LEFT JOIN facts USING (path)"
    ),
    "facts": (
        "SELECT path, concat_ws(chr(10), '', '', 'Classes/Structs:', "
        "'  **Fwd_' || o || '** (lines ' || (b + 3) || '-' || (b + 3) || ')', "
        "'  **Order_' || o || '** (lines ' || (b + 4) || '-' || (t + 4) || ')', "
        "'    Public API:', '      - int cust() const', "
        "CASE WHEN st = 'O' THEN '      - int n()' END, '    Internal (2 total): prio, id', "
        "CASE WHEN st = 'O' THEN '  **Line** (lines ' || (b + 8) || '-' || (b + 10) || ')' END, "
        "CASE WHEN st = 'O' THEN '    Public API:' END, CASE WHEN st = 'O' THEN '      - int n()' END, "
        "'', 'Public Functions:', '  - int Order_' || o || '::decl_only()', "
        "'', 'Internal Functions:', '    Internal (2 total): helper_' || o || ', hidden_' || o) AS facts FROM oline "
        "UNION ALL SELECT 'include/nation/nation_' || n_nationkey || '.h', concat_ws(chr(10), '', '', 'Classes/Structs:', "
        "'  **Nation_' || n_nationkey || '** (lines 3-5)', '    Public API:', '      - int region() const') FROM nation "
        "UNION ALL SELECT 'srcx/nation_' || n_nationkey || '.h', concat_ws(chr(10), '', '', 'Classes/Structs:', "
        "'  **Nation_' || n_nationkey || '** (lines 1-1)') FROM nation "
        "UNION ALL SELECT 'src/supplier/supp_' || s_suppkey || '.h', concat_ws(chr(10), '', '', 'Classes/Structs:', "
        "'  **Supplier_' || s_suppkey || '** (lines 4-10)', '    Public API:', "
        "'      - Supplier_' || s_suppkey || '(int key)', '      - int nation() const') FROM supplier "
        "UNION ALL SELECT path, concat_ws(chr(10), '', '', 'Public Functions:', '  - ' || signature) FROM func "
        "WHERE path LIKE 'src/part/%' OR path LIKE 'test/%'"
    ),
    "prompts": "{prompts:blocks}",
    "new_blocks": "SELECT * FROM blocks WHERE path IN (SELECT path FROM star_changed)",
    "new_prompts": "{prompts:new_blocks}",
    "docs": "{docs:prompts:star_hash:sides}",
    "new_docs": "{docs:new_prompts:star_changed:new_sides}",
    "doc_lines": (
        "SELECT doc_file, replace(regexp_replace(doc_file, '[.]md$', ''), '_', '/') AS name, "
        + ", ".join(
            f"coalesce({_strip(f'''replace(list_filter(string_split(content, chr(10)), lambda x: starts_with(x, '{m}'))[-1], '{m}', '')''')}, '') AS {n}"
            for m, n in (
                ("**Purpose**:", "purpose"),
                ("**Consumes**:", "consumes"),
                ("**Produces**:", "produces"),
            )
        )
        + " FROM docs"
    ),
    "cats": (
        "SELECT *, CASE WHEN contains(name, '/') THEN upper(left(name, 1)) || lower(substr(split_part(name, '/', 1), 2)) "
        "ELSE 'Core' END AS category FROM doc_lines"
    ),
    "over": (
        f"SELECT {_lit(chr(10).join(OVERVIEW_HEAD) + chr(10))} || "
        "(SELECT string_agg('### ' || category || chr(10) || chr(10) || bullets || chr(10) || chr(10), '' ORDER BY category) FROM ("
        "SELECT category, string_agg('- `' || name || '`' || CASE WHEN consumes <> '' OR produces <> '' THEN ' → ' || "
        "concat_ws(' | ', CASE WHEN consumes <> '' THEN 'consumes: ' || consumes END, "
        "CASE WHEN produces <> '' THEN 'produces: ' || produces END) ELSE '' END, chr(10) ORDER BY doc_file) AS bullets "
        "FROM cats GROUP BY category)) || '## Modules' || chr(10) || chr(10) || "
        "(SELECT string_agg('- [' || name || '](modules/' || doc_file || ') – ' || purpose, chr(10) ORDER BY doc_file) FROM cats) || "
        + _footer(_RUN)
        + " AS content"
    ),
    "marked": (
        "SELECT source AS repo, 'doc_' || doc_id || '.md' AS doc_file, concat_ws(chr(10), "
        "'**Purpose**:  first ' || lang, text, '**Consumes**: ' || source || ' **Consumes**: ' || chr(9), "
        "CASE WHEN lang = 'en' THEN '**Purpose**: last ' || source END, "
        "CASE WHEN lang <> 'de' THEN ' **Produces**: indented lines do not count' END, "
        "CASE WHEN lang = 'fr' THEN '**Produces**: lignes ' END) AS content FROM documents"
    ),
}


def _inc(orders: str, lines: str) -> str:
    """Includes of the order files: group, key, text, name and ordinal."""
    return (
        "SELECT *, trim(txt, '<>\"') AS name, row_number() OVER (PARTITION BY o ORDER BY g, k) - 1 AS ordinal FROM ("
        f"SELECT o, 0 AS g, 0 AS k, '<vector>' AS txt FROM {orders} "
        "UNION ALL SELECT DISTINCT l_orderkey, 1, l_partkey, '\"src/part/' || lower(p_type) || '/part_' || l_partkey || '.h\"' "
        f"FROM {lines} JOIN part ON l_partkey = p_partkey WHERE l_orderkey IN (SELECT o FROM {orders}) "
        "UNION ALL SELECT DISTINCT l_orderkey, 2, l_suppkey, '\"../../supplier/supp_' || l_suppkey || '.h\"' "
        f"FROM {lines} WHERE l_orderkey IN (SELECT o FROM {orders}) "
        f"UNION ALL SELECT o, 3, 0, '\"missing_' || o || '.h\"' FROM {orders} WHERE st = 'P' "
        f"UNION ALL SELECT o, 4, 0, '\"../../../../outside.h\"' FROM {orders} WHERE st = 'F' "
        f"UNION ALL SELECT o, 5, 0, '\"../../gone/cust_' || c || '.h\"' FROM {orders} WHERE d = '1')"
    )


def _files(orders: str, inc: str, lines: str, supplier: str) -> str:
    body = (
        _fill(c.ORDER_HEAD, o="o", c="c")
        + f" || CASE WHEN st = 'O' THEN {_fill(c.ORDER_NESTED, d='d')} ELSE '' END || "
        + _fill(c.ORDER_TAIL, o="o", d="d")
    )
    return (
        "SELECT 'src/orders/p' || d || '/order_' || o || '.cpp' AS path, head || "
        f"{body} AS content FROM {orders} JOIN (SELECT o, string_agg('#include ' || txt || chr(10), '' ORDER BY g, k) AS head FROM {inc} GROUP BY o) USING (o) "
        f"UNION ALL SELECT 'src/test/order_' || o || '_test.cpp', {_fill(c.NESTED_TEST, o='o')} FROM {orders} WHERE st = 'P' "
        f"UNION ALL SELECT 'test/order_' || o || '_test.cpp', {_fill(c.TOP_TEST, o='o')} FROM {orders} WHERE o NOT IN (SELECT l_orderkey FROM {lines}) "
        f"UNION ALL SELECT 'include/nation/nation_' || n_nationkey || '.h', {_fill(c.NATION_HEADER, name='n_name', n='n_nationkey', r='n_regionkey')} FROM nation "
        f"UNION ALL SELECT 'srcx/nation_' || n_nationkey || '.h', {_fill(c.LOOKALIKE_HEADER, n='n_nationkey')} FROM nation "
        f"UNION ALL SELECT 'src/supplier/supp_' || s_suppkey || '.h', {_fill(c.SUPPLIER_HEADER, n='s_nationkey', s='s_suppkey')} FROM {supplier} "
        f"UNION ALL SELECT 'src/part/' || lower(p_type) || '/part_' || p_partkey || '.h', {_fill(c.PART_HEADER, p='p_partkey', z='p_size')} FROM part"
    )


def _prompts(blocks: str) -> str:
    return (
        "SELECT *, sha256(prompt) AS prompt_hash FROM (SELECT module, count(*) AS n, "
        "string_agg('- ' || regexp_extract(path, '[^/]+$'), chr(10) ORDER BY path) AS file_list, "
        f"{_lit(PROMPT_HEAD + '## Module: ')} || module || chr(10) || 'Directory: ' || module || chr(10) || chr(10) || '## Files:' || chr(10) || "
        "file_list || chr(10) || chr(10) || '## Structure:' || chr(10) || string_agg(block, chr(10) ORDER BY path) || chr(10) AS prompt "
        f"FROM {blocks} GROUP BY module)"
    )


def _docs(prompts: str, hashes: str, sides: str) -> str:
    plain = _fill(c.COMPLETION, m="module")
    completion = (
        f"SELECT module, CASE length(module) % 4 WHEN 0 THEN {plain} "
        f"WHEN 1 THEN '```markdown' || chr(10) || {plain} || '```' "
        f"WHEN 2 THEN '```' || chr(10) || '**Purpose**: draft' || chr(10) || {plain} || chr(10) || '```' "
        "ELSE '# Module: ' || module || chr(10) || chr(10) || '**Purpose**: Holds ' || n || ' file(s).' || chr(10) || chr(10) || "
        "'**Location**: `' || module || '`' || chr(10) || chr(10) || '## File List' || chr(10) || chr(10) || file_list END AS completion "
        f"FROM {prompts}"
    )

    def links(side, title):
        return (
            f"coalesce((SELECT '{title}' || chr(10) || string_agg('- [' || other || '](./' || replace(other, '/', '_') || '.md)', chr(10) ORDER BY other) "
            f"|| chr(10) || chr(10) FROM {sides} s WHERE s.module = m.module AND side = '{side}'), '')"
        )

    related = links("depends_on", "**Depends on**:") + " || " + links("depended_by", "**Depended by**:")
    return (
        "SELECT module, replace(module, '/', '_') || '.md' AS doc_file, x || "
        + _footer(_RUN, "combined")
        + " || chr(10) || '---' || chr(10) || chr(10) || '## Related Modules' || chr(10) || chr(10) || "
        "CASE WHEN related = '' THEN '*No direct module dependencies detected.*' || chr(10) ELSE left(related, length(related) - 1) END AS content FROM "
        f"({_strip_fences(f'({completion})', 'completion', 'module')}) "
        f"JOIN (SELECT module, sha256(string_agg(file_hash, '' ORDER BY file_hash)) AS combined FROM {hashes} GROUP BY module) USING (module) "
        f"JOIN (SELECT module, {related} AS related FROM (SELECT DISTINCT module FROM {hashes}) m) USING (module)"
    )


_MACROS = {"inc": _inc, "files": _files, "prompts": _prompts, "docs": _docs}


def _body(name: str) -> str:
    text = CTES[name]
    macro = re.fullmatch(r"\{(\w+):(.*)\}", text)
    return _MACROS[macro[1]](*macro[2].split(":")) if macro else text


def _sql(query: str) -> str:
    """Query with the CTEs it needs, in dependency order."""
    ordered: list[str] = []

    def visit(text):
        for name in CTES:
            if name not in ordered and re.search(rf"(?:FROM|JOIN) {name}\b", text):
                visit(_body(name))
                if name not in ordered:
                    ordered.append(name)

    visit(query)
    if not ordered:
        return query
    ctes = ", ".join(f"{n} AS MATERIALIZED ({_body(n)})" for n in ordered)
    return f"WITH {ctes} {query}"


_BOTH = "(SELECT repo, path, content FROM prose UNION ALL SELECT 'star', path, content FROM star_all)"
_NO_SUFFIX = "regexp_replace(path, '([^/])[.][^./]+$', '\\1')"


def _glob_hits() -> str:
    """One condition per pattern, written by hand."""
    conds = {
        "src/**/*.h": "starts_with(path, 'src') AND ends_with(path, '.h')",
        "**/test/**": "contains(path, '/test/')",
        "src/**": "starts_with(path, 'src')",
        "*.cpp": "ends_with(path, '.cpp')",
        "src/??/d[0-4]/*": "regexp_full_match(path, 'src/../d[0-4]/.*')",
        "src/[!e]*/d?/*.[hp]*": "regexp_full_match(path, 'src/[^e].*/d./.*[.][hp].*')",
        "test/*": "starts_with(path, 'test/')",
        "**/p1/**/*_1.cpp": "regexp_full_match(path, '.*/p1/.*/.*_1[.]cpp')",
        "include/**/nation_[0-9].h": "starts_with(path, 'include') AND regexp_full_match(path, '.*nation_[0-9][.]h')",
    }
    assert tuple(conds) == GLOB_PATTERNS
    return " UNION ALL ".join(
        f"SELECT repo, path, {_lit(p)} AS pattern, {cond} AS matched FROM {_BOTH}"
        for p, cond in conds.items()
    )


_EFFECTIVE = (
    "SELECT repo, kind, pattern FROM own_rules UNION ALL "
    "SELECT repo, kind, pattern FROM (SELECT DISTINCT source AS repo FROM documents) CROSS JOIN (VALUES "
    + ", ".join(
        f"('{kind}', '{p}')"
        for kind, ps in (
            ("include", ["src/**/*.cpp", "src/**/*.h", "src/**/*.hpp", "include/**/*.h", "include/**/*.hpp"]),
            ("exclude", ["**/test/**", "**/tests/**", "**/vendor/**", "**/third_party/**", "**/build/**"]),
        )
        for p in ps
    )
    + ") AS v(kind, pattern) WHERE (repo, kind) NOT IN (SELECT repo, kind FROM own_rules)"
)

_SIDE_LIST = (
    "SELECT 'star' AS repo, module, string_agg(other, ',' ORDER BY other) AS {name} FROM sides "
    "WHERE side = '{side}' GROUP BY module"
)
_FENCED = (
    "(SELECT doc_id, CASE lang WHEN 'en' THEN '```markdown' || chr(10) || text || chr(10) || '```' "
    "WHEN 'fr' THEN '```' || chr(10) || text || ' ```' WHEN 'de' THEN '```markdown```' || text "
    "ELSE text || '```' END AS t FROM documents)"
)
_SYMBOLS = (
    "SELECT path, 'class' AS record, name, line_start, line_end FROM cls UNION ALL "
    "SELECT path, 'method', name, line_start, line_start FROM meth UNION ALL "
    "SELECT path, 'function', name, line_start, line_end FROM func"
)

_QUERIES = {
    "scan_source_files": f"SELECT repo, path, strlen(content) AS size FROM {_BOTH}",
    "read_text_valid_utf8": (
        "SELECT repo, path, length(content || '�' || repo) AS n_chars, "
        "sha256(content || '�' || repo) AS text_hash FROM prose"
    ),
    "path_rules_effective": _EFFECTIVE,
    "state_load": (
        "SELECT repo, path, file_hash, module FROM prose_hash WHERE repo <> 'src1' UNION ALL "
        "SELECT repo, path, file_hash, module FROM prose_state WHERE repo = 'src1'"
    ),
    "state_save": "SELECT 'star' AS repo, path, file_hash, module FROM star_hash",
    "module_docs_write": "SELECT 'star' AS repo, module, doc_file, 0 AS part, content FROM docs",
    "module_docs_read": "SELECT 'star' AS repo, doc_file, 0 AS part, content FROM docs",
    "overview_write": "SELECT 'star' AS repo, 0 AS part, content FROM over",
    "glob_match": _glob_hits(),
    "path_filter": (
        f"SELECT repo, path FROM prose WHERE {_SELECTED} AND (starts_with(path, 'src') OR starts_with(path, 'include')) "
        "AND (path LIKE '%.h' OR path LIKE '%.hpp' OR (path LIKE '%.cpp' AND starts_with(path, 'src'))) "
        "UNION ALL SELECT 'star', path FROM star"
    ),
    "changed_predicate": (
        "SELECT h.repo, h.path, s.file_hash AS old_hash, h.file_hash FROM prose_hash h "
        "LEFT JOIN prose_state s USING (repo, path) WHERE s.file_hash IS DISTINCT FROM h.file_hash"
    ),
    "imports_local_only": "SELECT path, ordinal, name FROM imp WHERE NOT is_system",
    "edges_no_self": (
        "SELECT path, name, module, target_module FROM local WHERE target_module <> module"
    ),
    "extraction_skips": (
        "SELECT 'star' AS repo, 'test/order_' || o || '_test.cpp' AS path, 'unbalanced' AS reason "
        "FROM ord WHERE o NOT IN (SELECT l_orderkey FROM lineitem)"
    ),
    "relative_path": (
        "SELECT CASE WHEN lang = 'es' THEN '/database/' ELSE '/data/' END || repo || '/' || path AS full_path, "
        "CASE WHEN lang <> 'es' THEN repo || '/' || path END AS path FROM prose"
    ),
    "content_hash": f"SELECT repo, path, 'sha256:' || sha256(content) AS file_hash FROM {_BOTH}",
    "module_name_directory": (
        "SELECT repo, path, "
        + ", ".join(f"{_module('path', d)} AS depth{d}" for d in (1, 2, 3, 4))
        + f" FROM {_BOTH}"
    ),
    "module_name_file": f"SELECT repo, path, {_NO_SUFFIX} AS module FROM {_BOTH}",
    "module_name_parent": f"SELECT repo, path, {_parent('path', 'root')} AS module FROM {_BOTH}",
    "module_path": (
        f"SELECT repo, path, CASE WHEN len(string_split(path, '/')) > 2 THEN {_module('path', 2)} "
        f"ELSE {_parent('path', '.')} END AS by_directory, {_parent('path', '.')} AS by_file FROM {_BOTH}"
    ),
    "language_of_file": (
        "SELECT repo, path, CASE WHEN lower(regexp_extract(path, '[^/]([.][^./]+)$', 1)) IN "
        "('.cpp', '.cc', '.cxx', '.c', '.h', '.hpp', '.hxx') THEN 'cpp' WHEN lower(path) LIKE '%.html' "
        f"OR lower(path) LIKE '%.htm' THEN 'html' END AS language FROM {_BOTH}"
    ),
    "doc_file_name": (
        f"SELECT repo, {_NO_SUFFIX} AS module, replace({_NO_SUFFIX}, '/', '_') || '.md' AS doc_file FROM {_BOTH}"
    ),
    "doc_display_name": (
        f"SELECT repo, replace({_NO_SUFFIX}, '/', '_') || '.md' AS doc_file, "
        f"replace({_NO_SUFFIX}, '_', '/') AS name FROM {_BOTH}"
    ),
    "short_hash": (
        "SELECT repo, module, left(sha256(string_agg(file_hash, '' ORDER BY file_hash)), 7) AS short_hash "
        "FROM prose_hash GROUP BY repo, module"
    ),
    "metadata_footer": (
        "SELECT o_orderkey, "
        + _footer("o_orderdate", "CASE WHEN o_orderstatus <> 'P' THEN sha256(o_orderkey::VARCHAR) END")
        + " AS footer FROM orders"
    ),
    "run_timestamp": (
        "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' "
        "THEN '' ELSE '.' || strftime(ts, '%f') END || 'Z' AS stamp FROM events"
    ),
    "include_classify": "SELECT p_partkey, p_name AS name, p_size % 3 = 0 AS is_system FROM part",
    "function_signature": (
        "SELECT path, line_start, signature FROM meth UNION ALL SELECT path, line_start, signature FROM func"
    ),
    "category_title": (
        "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'Core' ELSE array_to_string(list_transform("
        "regexp_extract_all(p_name || '-' || p_type || '-' || p_brand, '[A-Za-z]+|[^A-Za-z]+'), "
        "lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '') END AS category FROM part"
    ),
    "strip_fences": f"SELECT doc_id, x AS stripped FROM ({_strip_fences(_FENCED, 't', 'doc_id')})",
    "doc_markers": (
        "SELECT repo, doc_file, "
        + ", ".join(
            f"coalesce({_strip(f'''replace(list_filter(string_split(content, chr(10)), lambda x: starts_with(x, '{m}'))[-1], '{m}', '')''')}, '') AS {n}"
            for m, n in (
                ("**Purpose**:", "purpose"),
                ("**Consumes**:", "consumes"),
                ("**Produces**:", "produces"),
            )
        )
        + " FROM marked"
    ),
    "related_link_lines": (
        "SELECT module, side, '- [' || other || '](./' || replace(other, '/', '_') || '.md)' AS line FROM sides"
    ),
    "base_name": f"SELECT repo, path, regexp_extract(path, '[^/]*$') AS name FROM {_BOTH}",
    "normalize_path": "SELECT path, name, normalized FROM local",
    "changed_files": "SELECT 'star' AS repo, path, file_hash, module FROM star_changed",
    "change_kinds": (
        "SELECT 'star' AS repo, h.path, CASE WHEN s.file_hash IS NULL THEN 'added' "
        "WHEN s.file_hash <> h.file_hash THEN 'modified' ELSE 'unchanged' END AS change "
        "FROM star_hash h LEFT JOIN star_state s USING (path)"
    ),
    "resolve_exact": "SELECT path, name, exact_module FROM local",
    "resolve_relative": "SELECT path, name, relative_module FROM local",
    "resolve_imports": "SELECT path, name, target_module FROM local",
    "dependents_in_run": (
        "SELECT 'star' AS repo, src_module, dst_module FROM new_edges "
        "WHERE dst_module IN (SELECT module FROM new_modules)"
    ),
    "module_structures": (
        f"SELECT 'star' AS repo, {_module('path', 2)} AS module, count(*) AS n_files, count(*) FILTER ({_STAR_KEPT}) AS n_parsed, "
        "sum(coalesce(i, 0)) AS n_imports, sum(coalesce(k, 0)) AS n_classes, sum(coalesce(f, 0)) AS n_functions FROM star_all "
        "LEFT JOIN (SELECT path, count(*) AS i FROM imp GROUP BY path) USING (path) "
        "LEFT JOIN (SELECT path, count(*) AS k FROM cls GROUP BY path) USING (path) "
        "LEFT JOIN (SELECT path, count(*) AS f FROM func GROUP BY path) USING (path) GROUP BY 2"
    ),
    "glob_theta_join": (
        "SELECT repo, path FROM prose p WHERE NOT ("
        f"CASE WHEN repo IN (SELECT repo FROM own_rules WHERE kind = 'exclude') THEN "
        "EXISTS (SELECT 1 FROM own_rules r WHERE r.repo = p.repo AND kind = 'exclude' AND r.d = p.doc_id % 10 "
        "AND regexp_full_match(path, '.*[0-4][.].')) "
        f"ELSE NOT ({_SELECTED}) END) AND CASE WHEN repo IN (SELECT repo FROM own_rules WHERE kind = 'include') "
        "THEN EXISTS (SELECT 1 FROM own_rules r WHERE r.repo = p.repo AND kind = 'include' AND r.lang = p.lang) "
        "ELSE regexp_matches(path, '[.](cpp|h|hpp)$') END"
    ),
    "module_groups": (
        "SELECT repo, module, 0 AS part, module AS module_path, "
        "string_agg(path || '=' || file_hash, ',' ORDER BY path) AS files FROM prose_hash GROUP BY repo, module"
    ),
    "update_dry_run": (
        "SELECT 'star' AS repo, module, count(*) AS n_files FROM star_changed GROUP BY module"
    ),
    "status_summary": (
        "SELECT repo, coalesce(n, 0) AS n_changed, coalesce(n, 0) = 0 AS up_to_date, coalesce(p, '') AS first_paths, "
        "greatest(coalesce(n, 0) - 10, 0) AS n_more FROM (SELECT DISTINCT repo FROM prose) LEFT JOIN ("
        "SELECT repo, count(*) AS n, array_to_string(list(path ORDER BY path)[1:10], ',') AS p FROM prose_changed GROUP BY repo) USING (repo)"
    ),
    "status_top10": (
        "SELECT * FROM (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS place "
        "FROM prose_changed) WHERE place <= 10"
    ),
    "module_combined_hash": (
        "SELECT repo, module, sha256(string_agg(file_hash, '' ORDER BY file_hash)) AS combined_hash FROM "
        "(SELECT repo, module, file_hash FROM prose_hash UNION ALL SELECT 'star', module, file_hash FROM star_hash) "
        "GROUP BY repo, module"
    ),
    "state_modules_rollup": (
        f"SELECT 'star' AS repo, module, 0 AS part, {_STAMP} AS generated_at, "
        "string_agg(file_hash, ',' ORDER BY path) AS source_hashes FROM star_changed GROUP BY module"
    ),
    "module_dependencies": _SIDE_LIST.format(name="dependencies", side="depends_on"),
    "module_dependents": _SIDE_LIST.format(name="dependents", side="depended_by"),
    "dependency_graph": (
        "SELECT 'star' AS repo, module, coalesce(string_agg(other, ',' ORDER BY other) FILTER (side = 'depends_on'), '') AS dependencies, "
        "coalesce(string_agg(other, ',' ORDER BY other) FILTER (side = 'depended_by'), '') AS dependents "
        "FROM run_modules LEFT JOIN sides USING (module) GROUP BY module"
    ),
    "module_degrees": (
        "SELECT 'star' AS repo, module, count(other) FILTER (side = 'depends_on') AS n_dependencies, "
        "count(other) FILTER (side = 'depended_by') AS n_dependents FROM run_modules LEFT JOIN sides USING (module) GROUP BY module"
    ),
    "include_summary": (
        "SELECT path, count(*) FILTER (is_system) AS n_system, "
        "coalesce(string_agg(name, ', ' ORDER BY ordinal) FILTER (is_system), '') AS system_preview, "
        "count(*) FILTER (NOT is_system) AS n_local, "
        "coalesce(array_to_string((list(name ORDER BY ordinal) FILTER (NOT is_system))[1:10], ', '), '') || "
        "CASE WHEN count(*) FILTER (NOT is_system) > 10 THEN '...' ELSE '' END AS local_preview FROM imp GROUP BY path"
    ),
    "visibility_partition": (
        "SELECT cls.path, cls.name, "
        + ", ".join(
            f"coalesce(string_agg(m.name, ',' ORDER BY pos) FILTER (visibility = '{v}'), '') AS {n}"
            for v, n in (("public", "public"), ("protected", "protected"), ("private", "internal"))
        )
        + " FROM cls LEFT JOIN meth m ON m.path = cls.path AND m.owner_name = cls.name GROUP BY cls.path, cls.name"
    ),
    "internal_summary": (
        "SELECT path, 'Order_' || o AS owner, '    Internal (2 total): prio, id' AS line FROM oline UNION ALL "
        "SELECT path, '', '    Internal (2 total): helper_' || o || ', hidden_' || o FROM oline"
    ),
    "overview_categories": (
        "SELECT 'star' AS repo, category, 0 AS part, string_agg(name, ',' ORDER BY doc_file) AS names FROM cats GROUP BY category"
    ),
    "last_run": (
        "SELECT 'cust_' || o_custkey AS repo, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS last_run "
        "FROM orders GROUP BY o_custkey"
    ),
    "member_visibility": "SELECT path, owner_name, name, visibility FROM meth WHERE is_own",
    "enclosing_scope": (
        "SELECT m.path, m.name, m.line_start, kind AS parent_kind, true AS in_class, false AS in_unnamed_ns "
        "FROM meth m JOIN cls ON m.path = cls.path AND m.owner_name = cls.name WHERE is_own UNION ALL "
        "SELECT path, name, line_start, parent_kind, false, parent_kind = 'unnamed_namespace' FROM func"
    ),
    "first_n_preview": (
        "SELECT * FROM (SELECT repo, module, path, row_number() OVER (PARTITION BY repo, module ORDER BY path) AS place "
        "FROM prose_hash) WHERE place <= 10"
    ),
    "last_marker_wins": (
        "SELECT repo, doc_file, "
        + _strip(
            "replace(list_filter(string_split(content, chr(10)), lambda x: starts_with(x, '**Purpose**:'))[-1], '**Purpose**:', '')"
        )
        + " AS value FROM marked"
    ),
    "file_module_map": (
        "SELECT 'star' AS repo, path, coalesce(n.module, s.module) AS module FROM star_changed n FULL JOIN star_state s USING (path)"
    ),
    "file_map_union": (
        f"SELECT repo, path, {_module('path', 3)} AS module FROM prose_changed UNION ALL "
        "SELECT repo, path, module FROM prose_state WHERE (repo, path) NOT IN (SELECT repo, path FROM prose_changed)"
    ),
    "state_upsert": (
        "SELECT 'star' AS repo, path, coalesce(n.file_hash, s.file_hash) AS file_hash, coalesce(n.module, s.module) AS module "
        "FROM star_changed n FULL JOIN star_state s USING (path)"
    ),
    "related_sorted": (
        "SELECT module, side, string_agg(other, ' < ' ORDER BY other) AS others FROM sides GROUP BY module, side"
    ),
    "docs_sorted": "SELECT 'star' AS repo, doc_file, row_number() OVER (ORDER BY doc_file) AS place FROM docs",
    "categories_sorted": (
        "SELECT 'star' AS repo, category, '### ' || category AS line, row_number() OVER (ORDER BY category) AS place "
        "FROM (SELECT DISTINCT category FROM cats)"
    ),
    "changed_except": (
        "SELECT repo, path, file_hash FROM prose_hash EXCEPT SELECT repo, path, file_hash FROM prose_state"
    ),
    "edges_distinct": "SELECT 'star' AS repo, src_module, dst_module FROM edges",
    "extract_includes": "SELECT 'star' AS repo, path, ordinal, name, is_system FROM imp",
    "extract_classes": "SELECT path, kind, name, line_start, line_end FROM cls",
    "extract_methods": (
        "SELECT path, owner_name, name, signature, line_start, line_start AS line_end, visibility FROM meth WHERE is_own"
    ),
    "methods_with_nested": "SELECT path, owner_name, name, line_start, visibility, is_own FROM meth",
    "extract_functions": "SELECT path, name, line_start FROM func",
    "function_visibility": "SELECT path, name, visibility FROM func",
    "function_records": (
        "SELECT path, name, signature, line_start, line_end, visibility FROM func"
    ),
    "function_names": (
        "SELECT path, record, string_agg(name, ',' ORDER BY pos, name) AS names FROM ("
        "SELECT path, 'method' AS record, pos, name FROM meth UNION ALL SELECT path, 'function', pos, name FROM func) GROUP BY path, record"
    ),
    "symbol_line_ranges": _SYMBOLS,
    "file_structures": (
        "SELECT path, 'cpp' AS language, coalesce(i, '') AS imports, coalesce(k, '') AS classes, coalesce(f, '') AS functions FROM star "
        "LEFT JOIN (SELECT path, string_agg(name || ' ' || is_system, '; ' ORDER BY ordinal) AS i FROM imp GROUP BY path) USING (path) "
        "LEFT JOIN (SELECT path, string_agg(name || ' [' || coalesce(ms, '') || ']', '; ' ORDER BY kind, line_start) AS k FROM cls "
        "LEFT JOIN (SELECT path, owner_name AS name, string_agg(name, ',' ORDER BY pos) AS ms FROM meth GROUP BY path, owner_name) USING (path, name) "
        "GROUP BY path) USING (path) "
        "LEFT JOIN (SELECT path, string_agg(name || ' ' || visibility, '; ' ORDER BY pos) AS f FROM func GROUP BY path) USING (path)"
    ),
    "structure_summary": (
        "SELECT 'star' AS repo, module, 0 AS part, string_agg(block, chr(10) ORDER BY path) AS summary FROM blocks GROUP BY module"
    ),
    "file_list_text": (
        "SELECT repo, module, 0 AS part, string_agg('- ' || regexp_extract(path, '[^/]+$'), chr(10) ORDER BY path) AS file_list "
        "FROM prose_hash GROUP BY repo, module"
    ),
    "module_prompts": (
        "SELECT 'star' AS repo, module, 0 AS part, module AS module_path, prompt, prompt_hash FROM prompts"
    ),
    "related_modules": (
        "SELECT 'star' AS repo, module, 0 AS part, "
        "substr(content, position(chr(10) || '---' || chr(10) || chr(10) || '## Related' IN content)) AS section FROM docs"
    ),
    "module_docs": "SELECT 'star' AS repo, module, doc_file, 0 AS part, content FROM docs",
    "module_docs_incremental": (
        "SELECT 'star' AS repo, module, doc_file, 0 AS part, content FROM new_docs UNION ALL "
        "SELECT 'star', module, replace(module, '/', '_') || '.md', 0, 'saved ' || sha256(string_agg(file_hash, '' ORDER BY file_hash)) "
        "FROM star_hash WHERE module NOT IN (SELECT module FROM new_modules) GROUP BY module"
    ),
    "overview": "SELECT 'star' AS repo, 0 AS part, content FROM over",
    "extractor_registry": (
        "SELECT 'star' AS repo, path, ordinal, name, is_system, 'cpp' AS language FROM imp UNION ALL "
        "SELECT repo, path, n - 1, links[n], regexp_matches(links[n], '^[a-z]+://'), 'html' FROM ("
        "SELECT repo, path, links, unnest(range(1, len(links) + 1)) AS n FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS repo, "
        "regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1) AS path, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS links FROM pages))"
    ),
    "summarizer_hook": (
        "SELECT 'star' AS repo, prompt_hash, module || ' has a prompt of ' || "
        "(length(prompt) - length(replace(prompt, chr(10), ''))) || ' lines' AS text FROM prompts"
    ),
    "stream_changed_files": (
        "SELECT 'star' AS repo, path, 0 AS version, 'sha256:' || sha256(content) AS file_hash, 'added' AS change FROM star_all_old "
        "UNION ALL SELECT 'star', n.path, 1, 'sha256:' || sha256(n.content), CASE WHEN p.path IS NULL THEN 'added' ELSE 'modified' END "
        "FROM star_all n LEFT JOIN star_all_old p USING (path) WHERE p.content IS DISTINCT FROM n.content"
    ),
}

ORACLES = {name: _sql(query) for name, query in _QUERIES.items()}
