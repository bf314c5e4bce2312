"""Queries of the syntax-tree operators. Code is built from document columns, and the SQL builds the expected output alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrysift.functions import text as X
from quarrysift.functions.text import strip
from quarrysift.operators import code as C
from quarrysift.operators import workflow
from quarrysift.plans.registry import QUERIES, SQL, query, table, template
from quarrysift.session import spread
from quarrysift.sources.providers import EchoSpecs, SyntaxVerifier

#: name: (rewrite, options, cases of (code before, code after)); case i holds for documents with doc_id % cases = i.
REWRITES: dict[str, tuple[str, dict, list[tuple[str, str]]]] = {
    "tx_control_flow": ("control_flow", {}, [
        ("def f_{doc_id}(x):\n    if x > {n_chars}:\n        x += 1\n    else:\n        return", "def f_{doc_id}(x):\n    if not x > {n_chars}:\n        return\n    x += 1"),
        ("def f(x):\n    if x > {doc_id}:\n        a = 1\n    elif x > 2:\n        a = 2\n    else:\n        a = {n_chars}", "def f(x):\n    if x > {doc_id}:\n        a = 1\n    if not x > {doc_id} and x > 2:\n        a = 2\n    if not x > {doc_id} and (not x > 2):\n        a = {n_chars}"),
    ]),
    "tx_variable_naming": ("variable_naming", {}, [("def f(p):\n    total = p + {doc_id}\n    other = total * 2\n    total = other\n    return total + q", "def f(p):\n    var_0 = p + {doc_id}\n    var_1 = var_0 * 2\n    var_0 = var_1\n    return var_0 + q")]),
    "tx_expression": ("expression", {}, [
        ("x = f({doc_id}) + 1\ny = a * b", "sum_value = f({doc_id}) + 1\nx = sum_value\ny = a * b"),
        ("z = g(a[{doc_id}])\nw = v[i + {n_chars}]", "g_result = g(a[{doc_id}])\nz = g_result\nv_item = v[i + {n_chars}]\nw = v_item"),
        ("t = (a + b) ** {doc_id}", "temp_1 = (a + b) ** {doc_id}\nt = temp_1"),
    ]),
    "tx_loop_standard": ("loop_standard", {}, [
        ("for i in range(3):\n    for j in range(1, 5):\n        s += i * j + {doc_id}", "for flat_idx in range(3 * 4):\n    i = flat_idx // 4\n    j = 1 + flat_idx % 4\n    s += i * j + {doc_id}"),
        ("for i in range(n):\n    for j in range(i):\n        s += {doc_id}", "for i in range(n):\n    for j in range(i):\n        s += {doc_id}"),
        ("for i in range(2):\n    for j in range(3):\n        for k in range({doc_id}):\n            print(k)", "for flat_idx in range(2 * 3 * {doc_id}):\n    i = flat_idx // (3 * {doc_id})\n    j = flat_idx // {doc_id} % 3\n    k = flat_idx % {doc_id}\n    print(k)"),
    ]),
    "tx_function_extract": ("function_extract", {}, [("def f(x):  # {doc_id}\n    return x", "def f(x):  # {doc_id}\n    return x")]),
    "tx_drop_comments": ("drop_comments", {}, [("# {lang}\nx = {doc_id}  # why\ny = 'a # b'", "x = {doc_id}\ny = 'a # b'")]),
    "tx_drop_self": ("drop_self", {}, [("class A:\n\n    def f(self, x):\n        self.v = x + {doc_id}\n        return self.v", "class A:\n\n    def f(x):\n        v = x + {doc_id}\n        return v")]),
    "tx_drop_path": ("drop_path", {}, [("import a.b.c{doc_id}\nfrom p.q import r\nfrom s import t", "import c{doc_id}\nfrom q import r\nfrom s import t")]),
    "tx_drop_return": ("drop_return", {}, [("def f(x):\n    return x + {doc_id}", "def f(x):\n    x + {doc_id}"), ("def f(x):\n    if x == {doc_id}:\n        return\n    g(x)", "def f(x):\n    if x == {doc_id}:\n        pass\n    g(x)")]),
    "tx_drop_vars": ("drop_vars", {}, [("x = {doc_id}\ny: int = 2\nz: int\nprint(x)", "x = None\ny: int = None\nz: int\nprint(x)")]),
    "tx_drop_vars_declaration": ("drop_vars", {"declaration": True}, [("def f():\n    x = {doc_id}", "def f():\n    pass"), ("x = {doc_id}\nprint(x)", "print(x)")]),
    "tx_remove_exceptions": ("remove_exceptions", {}, [("try:\n    f({doc_id})\nexcept E:\n    g()\nfinally:\n    h()", "f({doc_id})"), ("def f():\n    raise E({doc_id})", "def f():\n    pass")]),
    "tx_remove_print": ("remove_print", {}, [("def f(x):\n    print(x, {doc_id})\n    return x", "def f(x):\n    pass\n    return x")]),
    "tx_remove_else": ("remove_else", {}, [("if x == {doc_id}:\n    f()\nelif y:\n    g()\nelse:\n    h()", "if x == {doc_id}:\n    f()"), ("try:\n    f({doc_id})\nexcept E:\n    g()\nelse:\n    h()", "try:\n    f({doc_id})\nexcept E:\n    g()")]),
    "tx_remove_docstrings": ("remove_docstrings", {}, [("def f(x):\n    'about {doc_id}'\n    return x", "def f(x):\n    return x"), ("class A:\n    'only {doc_id}'", "class A:\n    pass")]),
    "tx_log_statement": ("log_statement", {"position": 0}, [("def f(x):\n    'doc'\n    return x + {doc_id}", "def f(x):\n    \"\"\"doc\"\"\"\n    print('LOG: reached')\n    return x + {doc_id}")]),
    "tx_loop_exchange": ("loop_exchange", {}, [
        ("for i in range({doc_id}):\n    f(i)", "i = 0\nwhile i < {doc_id}:\n    f(i)\n    i += 1"),
        ("for i in range(9, {doc_id}, -2):\n    f(i)", "i = 9\nwhile i > {doc_id}:\n    f(i)\n    i += -2"),
        ("while k < {n_chars}:\n    f(k)\n    k += 3", "for k in range(0, {n_chars}, 3):\n    f(k)"),
    ]),
    "tx_reorder_condition": ("reorder_condition", {}, [
        ("if a < {doc_id} and b >= c:\n    f()", "if c <= b and {doc_id} > a:\n    f()"),
        ("while x in y or not a == {doc_id}:\n    f(x < 1)", "while not {doc_id} == a or x in y:\n    f(x < 1)"),
    ]),
    "tx_try_catch_insertion": ("try_catch_insertion", {"seed": 1}, [("def f(x):\n    'doc'\n    return x + {doc_id}", "def f(x):\n    \"\"\"doc\"\"\"\n    try:\n        return x + {doc_id}\n    except Exception:\n        raise")]),
    "tx_try_catch_masking": ("try_catch_insertion", {"seed": 1, "mode": "masking"}, [("def f(x):\n    g({doc_id})", "def f(x):\n    try:\n        g({doc_id})\n    except Exception:\n        pass")]),
    "tx_try_catch_finally": ("try_catch_insertion", {"seed": 1, "mode": "finally"}, [("def f(x):\n    g({doc_id})", "def f(x):\n    try:\n        g({doc_id})\n    finally:\n        pass")]),
    "tx_dead_code_insertion": ("dead_code_insertion", {"position": "top", "payloads": ("assign",)}, [("def f(x):\n    a = {doc_id}\n    return a", "def f(x):\n    a = {doc_id}\n    if False:\n        _unused_0 = 0\n    return a")]),
    "tx_dead_code_bottom": ("dead_code_insertion", {"position": "bottom", "payloads": ("loop",)}, [("def f(x):\n    g({doc_id})", "def f(x):\n    g({doc_id})\n    if False:\n        for _i in range(0):\n            pass")]),
    "tx_boolean_exchange": ("boolean_exchange", {}, [("def f():\n    ok = True\n    n = {doc_id}\n    if ok:\n        return n\n    return ok", "def f():\n    ok = True\n    n = {doc_id}\n    if False:\n        return n\n    return False")]),
    "tx_switch_to_if": ("switch_to_if", {}, [
        ("match x:\n    case 1:\n        f()\n    case 2 | 3:\n        g({doc_id})\n    case _:\n        h()", "if x == 1:\n    f()\nelif x == 2 or x == 3:\n    g({doc_id})\nelse:\n    h()"),
        ("match x:\n    case _:\n        g({doc_id})", "g({doc_id})"),
        ("match x:\n    case [a, b]:\n        g({doc_id})", "match x:\n    case [a, b]:\n        g({doc_id})"),
    ]),
    "tx_if_normalize": ("if_normalize", {}, [
        ("if not (a and b > {doc_id}):\n    f()", "if not a or not b > {doc_id}:\n    f()"),
        ("if not a:\n    f({doc_id})\nelse:\n    g()", "if a:\n    g()\nelse:\n    f({doc_id})"),
        ("if a:\n    if b == {doc_id}:\n        f()", "if a and b == {doc_id}:\n    f()"),
        ("def f(x):\n    if x > {doc_id}:\n        return 1\n    else:\n        return 2", "def f(x):\n    if x > {doc_id}:\n        return 1\n    return 2"),
    ]),
    "tx_if_invert": ("if_invert", {}, [("if x > {doc_id}:\n    f()", "if not x > {doc_id}:\n    pass\nelse:\n    f()"), ("if x > {doc_id}:\n    f()\nelse:\n    g()", "if not x > {doc_id}:\n    g()\nelse:\n    f()")]),
}


def _cases(texts: list[str]) -> str:
    if len(texts) == 1:
        return template(texts[0])
    return "CASE " + " ".join(f"WHEN doc_id % {len(texts)} = {i} THEN {template(t)}" for i, t in enumerate(texts)) + " END"


def _add(name: str, rewrite: str, options: dict, cases: list[tuple[str, str]]) -> None:
    def run(spark, d):
        code = F.expr(_cases([a for a, _ in cases]))
        rows = spread(table(spark, d, "documents").select("doc_id", code.alias("code")))
        out = rows.select("doc_id", C.rewrite(F.col("code"), [rewrite], {rewrite: options}).alias("r"))
        return out.select("doc_id", "r.code", F.col("r.error").alias("error"))

    QUERIES[name] = run
    SQL[name] = f"SELECT doc_id, {_cases([b for _, b in cases])} AS code, NULL::VARCHAR AS error FROM documents"


for _name, (_rewrite, _options, _list) in REWRITES.items():
    _add(_name, _rewrite, _options, _list)

# ---- text rewrites: native, no Python -------------------------------------------------------------------------------


@query("SELECT doc_id, replace(replace(text || '(a)', '(', ''), ')', '') AS code FROM documents")
def tx_replace_parentheses(spark, d):
    return table(spark, d, "documents").select("doc_id", F.translate(F.concat("text", F.lit("(a)")), "()", "").alias("code"))


_INDENTED = template("def f():\n    x = {doc_id}\n\n        y = 2\nz")


@query(f"SELECT doc_id, {template('def f():{nl}x = {doc_id}{nl}{nl}y = 2{nl}z').replace('CAST(nl AS STRING)', 'chr(10)')} AS code, {template('def f():{nl}    x = {doc_id}{nl}{nl}    y = 2{nl}z').replace('CAST(nl AS STRING)', 'chr(10)')} AS flat FROM documents")
def tx_forget_indent(spark, d):
    each = lambda c, f: F.array_join(F.transform(X.lines(c), lambda x: F.when(strip(x) == "", x).otherwise(f(x))), "\n")
    rows = table(spark, d, "documents").select("doc_id", F.expr(_INDENTED).alias("c"))
    flat = lambda x: F.concat(F.when(x.rlike(r"^\s"), "    ").otherwise(""), X.lstrip(x))
    return rows.select("doc_id", each(F.col("c"), X.lstrip).alias("code"), each(F.col("c"), flat).alias("flat"))


# ---- random rewrites: what any of their results must keep ------------------------------------------------------------


def _kept(rows, first: int, last: int):
    """The lines that stay in place at the start and the end of a program, and all lines in order of their text."""
    of = X.lines(F.col("code"))
    ends = F.concat(F.slice(of, 1, first), F.slice(of, F.size(of) - last + 1, last))
    return rows.select("doc_id", F.array_join(ends, "\n").alias("ends"), F.array_join(F.array_sort(of), "\n").alias("sorted"))


def _kept_sql(lines: list[str], ends: list[str]) -> str:
    return f"SELECT doc_id, {template(chr(10).join(ends))} AS ends, array_to_string(list_sort([{', '.join(map(template, lines))}]), chr(10)) AS sorted FROM documents"


_FREE = ["    x = a + {doc_id}", "    y = b * 2", "    z = len(a)"]
_ENDS = ["def f(a, b):", "    return x + y + z"]


@query(_kept_sql([*_ENDS, *_FREE], _ENDS))
def tx_permute_statement(spark, d):
    """Any order of the three independent statements; nothing else moves."""
    code = F.expr(template("\n".join([_ENDS[0], *_FREE, _ENDS[1]])))
    return _kept(table(spark, d, "documents").select("doc_id", C.rewrite(code, ["permute_statement"])["code"].alias("code")), 1, 1)


_LOGGED = ["def f_{doc_id}(a):", "    x = a", "    y = x", "    return y"]


@query(_kept_sql([*_LOGGED, "    print('LOG: reached')"], [_LOGGED[0]]))
def tx_log_statement_random(spark, d):
    """One line more, anywhere in the body."""
    code = F.expr(template("\n".join(_LOGGED)))
    return _kept(table(spark, d, "documents").select("doc_id", C.rewrite(code, ["log_statement"], {"log_statement": {"seed": 7}})["code"].alias("code")), 1, 0)


# ---- features -------------------------------------------------------------------------------------------------------

#: Four programs: a function with branch and loop, a class with try and match, an invalid one, plain statements.
PROGRAMS = (
    f"CASE doc_id % 4 WHEN 0 THEN {template('def f_{doc_id}(x):{nl}    if x:{nl}        for i in x:{nl}            while i:{nl}                i -= 1{nl}    return x')} WHEN 1 THEN {template('class A{doc_id}:{nl}    def g(self):{nl}        try:{nl}            match x:{nl}                case 1: pass{nl}        finally: pass')} "
    f"WHEN 2 THEN {template('def broken({doc_id}')} ELSE {template('x = {doc_id}{nl}y = 2')} END"
).replace("CAST(nl AS STRING)", "chr(10)")


def _programs(spark, d):
    return spread(table(spark, d, "documents").selectExpr("doc_id", f"{PROGRAMS} AS code")).withColumn("f", C.code_features(F.col("code")))


@query("SELECT doc_id, doc_id % 4 = 0 AS has_if, doc_id % 4 = 0 AS has_loop, doc_id % 4 = 1 AS has_switch FROM documents")
def has_constructs(spark, d):
    return _programs(spark, d).select("doc_id", "f.has_if", "f.has_loop", "f.has_switch")


@query("SELECT unnest(CASE doc_id % 4 WHEN 0 THEN ['if', 'loop', 'both'] WHEN 1 THEN ['switch'] ELSE [] END) AS subset, doc_id FROM documents")
def subset_by_construct(spark, d):
    f = F.col("f")
    tests = {"if": f["has_if"], "loop": f["has_loop"], "both": f["has_if"] & f["has_loop"], "switch": f["has_switch"], "switch_loop": f["has_switch"] & f["has_loop"]}
    return _programs(spark, d).select(F.explode(F.array_compact(F.array(*[F.when(t, k) for k, t in tests.items()]))).alias("subset"), "doc_id")


@query("SELECT count_if(doc_id % 4 = 0)::BIGINT AS with_if, count_if(doc_id % 4 = 0)::BIGINT AS with_loop, count_if(doc_id % 4 = 0)::BIGINT AS with_both, count_if(doc_id % 4 = 1)::BIGINT AS with_switch, 0::BIGINT AS with_switch_loop FROM documents")
def construct_summary(spark, d):
    f = F.col("f")
    return _programs(spark, d).agg(F.count_if(f["has_if"]).alias("with_if"), F.count_if(f["has_loop"]).alias("with_loop"), F.count_if(f["has_if"] & f["has_loop"]).alias("with_both"), F.count_if(f["has_switch"]).alias("with_switch"), F.count_if(f["has_switch"] & f["has_loop"]).alias("with_switch_loop"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 7 WHEN 1 THEN 7 WHEN 2 THEN -1 ELSE 0 END AS complexity, CASE doc_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN -1 ELSE 0 END AS complexity_v1 FROM documents")
def complexity_score(spark, d):
    return _programs(spark, d).select("doc_id", "f.complexity", "f.complexity_v1")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'f_' || doc_id WHEN 1 THEN 'A' || doc_id WHEN 2 THEN 'invalid' ELSE 'unknown' END AS primary_name FROM documents")
def primary_name(spark, d):
    return _programs(spark, d).select("doc_id", "f.primary_name")


_LONG = f"{PROGRAMS} || repeat(chr(10) || '# note' || chr(10) || 'z = 1', CAST(doc_id % 12 AS INT))"


@query("SELECT doc_id, n + doc_id % 12 >= 15 AND doc_id % 4 < 2 AS suitable, n + doc_id % 12 >= 10 AND doc_id % 4 < 2 AS complex_enough FROM (SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 6 ELSE 2 END AS n FROM documents)")
def is_suitable(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", f"{_LONG} AS code").withColumn("f", C.code_features(F.col("code")))
    return rows.select("doc_id", C.suitable(F.col("code"), F.col("f")).alias("suitable"), C.complex_enough(F.col("code"), F.col("f")).alias("complex_enough"))


# ---- drivers of the rewrites ----------------------------------------------------------------------------------------

_IF_OR_NOT = f"CASE doc_id % 3 WHEN 0 THEN {template('if x > {doc_id}:{nl}    f()')} WHEN 1 THEN {template('f({doc_id})  # same')} ELSE '  ' END".replace("CAST(nl AS STRING)", "chr(10)")
_INVERTED = template("if not x > {doc_id}:{nl}    pass{nl}else:{nl}    f()").replace("CAST(nl AS STRING)", "chr(10)")


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_INVERTED} ELSE {template('f({doc_id})  # same')} END AS code, 'if_invert' AS transformation_type, 'if_invert,remove_print' AS applied, NULL::VARCHAR AS transformation_error, 'p' || doc_id || '__if_invert.py' AS output_filename FROM documents WHERE doc_id % 3 < 2")
def transform_dataset(spark, d):
    rows = spread(table(spark, d, "documents").selectExpr("doc_id", f"{_IF_OR_NOT} AS code", "'in/p' || doc_id || '.py' AS path"))
    out = C.transform_dataset(rows, ["if_invert", "remove_print"], path="path")
    return out.select("doc_id", "code", "transformation_type", F.array_join("applied_transformers", ",").alias("applied"), "transformation_error", "output_filename")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def changed_only(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", f"{_IF_OR_NOT} AS code")
    return C.transform_dataset(rows, ["if_invert"], changed_only=True).select("doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 'failed' ELSE 'done' END AS part FROM documents")
def process_dataset(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", f"{PROGRAMS} AS code")
    done, failed = C.process_dataset(rows, ["drop_comments"])
    return done.select("doc_id", F.lit("done").alias("part")).unionByName(failed.select("doc_id", F.lit("failed").alias("part")))


@query(f"SELECT doc_id, {template('def f():{nl}    return').replace('CAST(nl AS STRING)', 'chr(10)')} || ' ' || doc_id AS code FROM documents")
def transform_code(spark, d):
    """Several rewrites in one pass: comments and docstrings go, then the exception."""
    code = F.expr(template("def f():\n    'doc'\n    try:\n        return {doc_id}  # why\n    except E:\n        raise"))
    return table(spark, d, "documents").select("doc_id", C.rewrite(code, ["drop_comments", "remove_docstrings", "remove_exceptions"])["code"].alias("code"))


# ---- slices ---------------------------------------------------------------------------------------------------------

_MODULE = template("import os\nK = {doc_id}\nL = 5\n\ndef a(x):\n    return b(x) + K\n\ndef b(y):\n    'help'\n    return y")
_nl = lambda t: template(t)


@query(
    f"""SELECT doc_id, 'a' AS function, {_nl("import os{0}K = {doc_id}{0}{0}def b(y):{0}    raise NotImplementedError(){0}{0}def a(x):{0}    return b(x) + K".replace("{0}", chr(10)))} AS code, 'K' AS consts, 'b' AS helpers, 1 AS imports_included, 8 AS lines_out FROM documents
    UNION ALL SELECT doc_id, 'b', {_nl("import os{0}{0}def b(y):{0}    \"\"\"help\"\"\"{0}    return y".replace("{0}", chr(10)))}, '', '', 1, 5 FROM documents"""
)
def slice_functions(spark, d):
    rows = C.slice_functions(spread(table(spark, d, "documents").select("doc_id", F.expr(_MODULE).alias("code"))))
    return rows.select("doc_id", "function", "code", F.array_join("needed_consts", ",").alias("consts"), F.array_join("stubbed_helpers", ",").alias("helpers"), "imports_included", "lines_out")


@query("SELECT doc_id, unnest(['a', 'b']) AS function FROM documents")
def slice_functions_udtf(spark, d):
    """The same as a table function in SQL."""
    C.register(spark)
    table(spark, d, "documents").select("doc_id", F.expr(_MODULE).alias("code")).createOrReplaceTempView("quarrysift_modules")
    return spark.sql("SELECT doc_id, s.function FROM quarrysift_modules, LATERAL slice_functions(code) s")


@query(
    f"""SELECT doc_id, 'a' AS function, {_nl("def a(x):{0}    return b(x) + K{0}".replace("{0}", chr(10)))} AS code FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'b', {_nl("def b(y):{0}    'help'{0}    return y{0}".replace("{0}", chr(10)))} FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, NULL, {_nl("x = {doc_id}{0}".replace("{0}", chr(10)))} FROM documents WHERE doc_id % 2 = 1"""
)
def split_top_level(spark, d):
    code = F.expr(f"CASE WHEN doc_id % 2 = 0 THEN {_MODULE} ELSE {template('x = {doc_id}')} END")
    return C.split_top_level(table(spark, d, "documents").select("doc_id", code.alias("code"))).select("doc_id", "function", "code")


@query("SELECT doc_id, unnest(['a', 'b']) AS function_name, unnest(['5-6', '8-10']) AS line_range, unnest(['', 'help']) AS docstring FROM documents")
def extract_functions(spark, d):
    return C.extract_functions(table(spark, d, "documents").select("doc_id", F.expr(_MODULE).alias("code"))).select("doc_id", "function_name", "line_range", "docstring")


def _flag(name: str, remainder: int) -> None:
    QUERIES[name] = lambda spark, d: _programs(spark, d).where(F.col("f")[name]).select("doc_id")
    SQL[name] = f"SELECT doc_id FROM documents WHERE doc_id % 4 = {remainder}"


for _name, _remainder in (("has_if", 0), ("has_loop", 0), ("has_switch", 1)):
    _flag(_name, _remainder)


@query("SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 6 ELSE 2 END AS n FROM documents) WHERE n + doc_id % 12 >= 10 AND doc_id % 4 < 2")
def is_complex_enough(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", f"{_LONG} AS code").withColumn("f", C.code_features(F.col("code")))
    return rows.where(C.complex_enough(F.col("code"), F.col("f"))).select("doc_id")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN -1 ELSE 0 END AS complexity_v1 FROM documents")
def complexity_score_v1(spark, d):
    return _programs(spark, d).select("doc_id", "f.complexity_v1")


@query(f"SELECT doc_id, {template('def f():{nl}x = {doc_id}{nl}{nl}y = 2{nl}z').replace('CAST(nl AS STRING)', 'chr(10)')} AS code FROM documents")
def tx_remove_indent(spark, d):
    """By the registry's name, as one of a request's rewrites; tx_forget_indent is the native form."""
    code = F.expr(template("def f():\n    x = {doc_id}\n\n        y = 2\nz").replace("        y", "    y"))
    return table(spark, d, "documents").select("doc_id", C.rewrite(code, ["remove_indent"])["code"].alias("code"))


@query(f"SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN {template('var_0 = {doc_id}')} END AS code, doc_id % 2 = 1 AS failed FROM documents")
def pipeline_transform_code(spark, d):
    """The variant with core rewrites (names are among them) that always writes the tree out again; an error leaves no code."""
    code = F.expr(f"CASE WHEN doc_id % 2 = 0 THEN {template('    x = ({doc_id})  # why')} ELSE 'def (' END")
    rows = spread(table(spark, d, "documents").select("doc_id", code.alias("code")))
    return rows.select("doc_id", C.pipeline_rewrite(F.col("code"), ["drop_comments"]).alias("r")).select("doc_id", "r.code", F.col("r.error").isNotNull().alias("failed"))


_CSR = "for i in range({doc_id}):\n    for k in range(ptr[i], ptr[i + 1]):\n        y[i] += data[k] * x[col[k]]"
_CSR_FLAT = "i = 0\nfor k in range(ptr[0], ptr[{doc_id}]):\n    while k >= ptr[i + 1]:\n        i += 1\n    y[i] += data[k] * x[col[k]]"


@query(f"SELECT doc_id, {template(_CSR_FLAT)} AS code FROM documents")
def tx_loop_standard_rows(spark, d):
    """Loops over the rows of a compressed sparse matrix."""
    rows = spread(table(spark, d, "documents").select("doc_id", F.expr(template(_CSR)).alias("code")))
    return rows.select("doc_id", C.rewrite(F.col("code"), ["loop_standard"])["code"].alias("code"))


@query(
    """SELECT count_if(doc_id % 3 < 2)::BIGINT AS total_files, count_if(doc_id % 3 = 0)::BIGINT AS verified_files, count_if(doc_id % 3 = 0)::BIGINT AS compiled_files,
    count_if(doc_id % 3 = 1)::BIGINT AS parse_error_files, 0::BIGINT AS failed_rewrites FROM documents"""
)
def end_to_end(spark, d):
    """All steps over a program for each document: valid ones, ones that the stand-in verifier rejects, and blank ones."""
    code = F.expr(f"CASE doc_id % 3 WHEN 0 THEN {template('x = {doc_id}')} WHEN 1 THEN {template('print({doc_id})')} ELSE '  ' END")
    programs = spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("in/p"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), code.alias("code"), F.col("doc_id").alias("seq")))
    steps = workflow.run(programs, BrokenSpecs("You write specifications.", "Specify:\n{code}"), SyntaxVerifier(), ["drop_comments"])
    failed = steps["failed"].agg(F.count(F.lit(1)).alias("failed_rewrites"))
    return steps["report"].select("total_files", "verified_files", "compiled_files", "parse_error_files").crossJoin(F.broadcast(failed))  # two rows of totals


class BrokenSpecs(EchoSpecs):
    """Specifications that are no program where the code prints."""

    def specify(self, codes):
        return super().specify(["def (" if c.startswith("print") else c for c in codes])
