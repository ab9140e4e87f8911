"""Queries that read sources, logs and texts, and write digests. The texts are built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft.operators import ingest, scopes
from graphweft.plans.base import query
from graphweft.sources import files, history, sinks
from graphweft.sources import testgraph as tg


def _tree(spark, d):
    """Files of parts: sources, documents, configurations and things to ignore."""
    return tg.table(spark, d, "part").selectExpr(
        "p_partkey as k", "element_at(array(concat('src/a', p_partkey, '.py'), concat('docs/d', p_partkey, '.md'), concat('node_modules/x/i', p_partkey, '.js'), concat('gen/out', p_partkey, '.ts'), concat('conf/c', p_partkey, '.json')), int(p_partkey % 5 + 1)) as file_path"
    )


_TREE = "tree as (select p_partkey as k, case p_partkey % 5 when 0 then 'src/a' || p_partkey || '.py' when 1 then 'docs/d' || p_partkey || '.md' when 2 then 'node_modules/x/i' || p_partkey || '.js' when 3 then 'gen/out' || p_partkey || '.ts' else 'conf/c' || p_partkey || '.json' end as file_path from part)"


@query(f"with {_TREE} select file_path, k % 5 in (2, 3) as ignored, case k % 5 when 0 then 'python' when 2 then 'javascript' when 3 then 'typescript' end as language from tree", graph=False)
def s4_s5_ignored_and_language(spark, d):
    names, globs = files.ignore_rules("# rules\n!kept\nbuild/\ngen/out*.ts\n")
    path = F.col("file_path")
    return _tree(spark, d).select("file_path", files.is_ignored(path, [*files.IGNORED, *names], globs).alias("ignored"), files.language_of(path).alias("language"))


@query(
    f"""with {_TREE} select case k % 5 when 1 then 'Document' else 'Config' end as type, string_split(file_path, '/')[-1] as label, file_path from tree where k % 5 in (1, 4)
    union all select 'Directory', string_split(f, '/')[-1], f from (values ('src'), ('docs'), ('node_modules'), ('node_modules/x'), ('gen'), ('conf')) t(f)""",
    graph=False,
)
def s2_special_nodes(spark, d):
    return files.special_nodes(_tree(spark, d)).drop("id")


@query("select distinct 'src/' || p_brand || '.py' as file_path from part", graph=False)
def s3_listed_files(spark, d):
    return history.listed(tg.table(spark, d, "part").selectExpr("if(p_size % 2 = 0, concat('\"src\\\\', p_brand, '.py\"'), concat('src/', p_brand, '.py')) as value").unionAll(spark.createDataFrame([("",)], "value string")))


@query(
    """select 'c' || n_nationkey as commit, n_nationkey * 1000 as seconds, 'A ' || n_name as author, 'mend ' || n_nationkey as subject, case when n_nationkey % 3 > 0 then 'src/f' || i || '.py' end as file_path from nation cross join range(2) t(i) where i < greatest(n_nationkey % 3, 1)""", graph=False
)
def s11_log(spark, d):
    mark, cut = "char(1)", "char(2)"
    files_ = "case n_nationkey % 3 when 0 then '' when 1 then '\\n\\nsrc/f0.py\\n' else '\\n\\nsrc/f0.py\\nsrc/f1.py\\n' end"
    one = f"concat({mark}, 'c', n_nationkey, {cut}, n_nationkey * 1000, {cut}, 'A ', n_name, {cut}, 'mend ', n_nationkey, {files_})"
    text = tg.table(spark, d, "nation").selectExpr(f"concat_ws('', collect_list({one})) as value")
    return history.log(text).select("commit", F.unix_timestamp("time").cast("int").alias("seconds"), "author", "subject", "file_path")


@query("select case p_partkey % 3 when 0 then 'M' when 1 then 'R' else 'D' end as status, 'src/a' || p_partkey || '.py' as file_path, case when p_partkey % 3 = 1 then 'old/a' || p_partkey || '.py' end as old_path from part", graph=False)
def s12_changed_files(spark, d):
    k = "p_partkey"
    line = f"element_at(array(concat('M\\tsrc/a', {k}, '.py'), concat('R087\\told/a', {k}, '.py\\tsrc/a', {k}, '.py'), concat('D\\tsrc/a', {k}, '.py')), int({k} % 3 + 1))"
    return history.changed(tg.table(spark, d, "part").selectExpr(f"{line} as value"))


@query("select 'src/a' || p_partkey || '.py' as file_path, p_partkey % 3 = 1 as staged, p_partkey % 3 = 2 as untracked from part", graph=False)
def s13_working_tree(spark, d):
    line = "concat(element_at(array(' M ', 'A  ', '?? '), int(p_partkey % 3 + 1)), 'src/a', p_partkey, '.py')"
    return history.working_tree(tg.table(spark, d, "part").selectExpr(f"{line} as value"))


@query("select doc_id::varchar as file_path, n as line_no from (select doc_id, generate_subscripts(l, 1) as n, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents)) where regexp_matches(line, '(^|[^A-Za-z0-9_$])that($|[^A-Za-z0-9_$])')", graph=False)
def s14_occurrences(spark, d):
    docs = tg.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content"))
    return files.occurrences(docs, "that").select("file_path", "line_no")


@query("select n as line_no, line from (select generate_subscripts(l, 1) as n, unnest(l) as line from (select string_split(text, chr(10)) as l from documents where doc_id = 3)) where n between 2 and 4", graph=False)
def s16_window(spark, d):
    docs = tg.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content"))
    return files.window(docs, "3", 2, 90, most=3)


@query("""select count(*) as n, sum(('0x' || substr(sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}'), 1, 15))::bigint)::varchar as digest from nation""", graph=False)
def s20_table_digest(spark, d):
    return sinks.digest(tg.table(spark, d, "nation"))


def _python(spark, d):
    body = "concat('import os\\nfrom lib import x', n_nationkey, '\\n\\n@mark\\nclass C', n_nationkey, '(Base):\\n    def run(self, a):\\n        return helper(os.path.join(a))\\n\\ndef test_it():\\n    run()\\n')"
    return tg.table(spark, d, "nation").selectExpr("concat('pkg/m', n_nationkey, '.py') as file_path", "'python' as language", f"if(n_nationkey = 7, 'def broken(', {body}) as content")


@query(
    """select 'pkg/m' || k || '.py' as file_path, type, replace(qname, '#', k::varchar) as qname, first as start_line, last as end_line, signature from (select n_nationkey as k from nation where n_nationkey <> 7) cross join
    (values ('Class', 'pkg.m#.C#', 5, 7, ''), ('Method', 'pkg.m#.C#.run', 6, 7, 'run(self, a)'), ('Test', 'pkg.m#.test_it', 9, 10, 'test_it()')) t(type, qname, first, last, signature)""",
    graph=False,
)
def i1_python_symbols(spark, d):
    return ingest.python_symbols(_python(spark, d))[0].select("file_path", "type", "qname", "start_line", "end_line", "signature")


@query(
    """select 'pkg/m' || k || '.py' as source_file, relation, replace(target, '#', k::varchar) as target, line as source_line from (select n_nationkey as k from nation where n_nationkey <> 7) cross join
    (values ('IMPORTS', 'os', 1), ('IMPORTS', 'lib.x#', 2), ('REFERENCES', 'mark', 4), ('EXTENDS', 'Base', 5), ('CALLS', 'helper', 7), ('CALLS', 'join', 7), ('TESTS', 'run', 10)) t(relation, target, line)""",
    graph=False,
)
def i1_i13_python_references(spark, d):
    return ingest.python_symbols(_python(spark, d))[1].select("source_file", "relation", "target", "source_line")


@query(
    """select 'src/m' || k || case lang when 'go' then '.go' when 'rust' then '.rs' else '.js' end as file_path, lang as language, type, replace(label, '#', k::varchar) as label, line as start_line from (select n_nationkey as k from nation) cross join
    (values ('go', 'Function', 'Run#', 3), ('go', 'Type', 'Box#', 4), ('rust', 'Function', 'run_#', 1), ('rust', 'Class', 'Box', 2), ('javascript', 'Class', 'Box#', 2), ('javascript', 'Function', 'run', 3), ('javascript', 'Function', 'arrow#', 4)) t(lang, type, label, line)""",
    graph=False,
)
def i2_ruled_symbols(spark, d):
    n = tg.table(spark, d, "nation")
    k = "n_nationkey"
    go = n.selectExpr(f"concat('src/m', {k}, '.go') as file_path", "'go' as language", f"concat('package a\\n// func No() {{\\nfunc Run', {k}, '(a int) {{}}\\ntype Box', {k}, ' struct {{}}') as content")
    rust = n.selectExpr(f"concat('src/m', {k}, '.rs') as file_path", "'rust' as language", f"concat('pub fn run_', {k}, '() {{}}\\nstruct Box;\\n/* fn no() */') as content")
    script = n.selectExpr(f"concat('src/m', {k}, '.js') as file_path", "'javascript' as language", f"concat('// class No\\nclass Box', {k}, ' {{}}\\nfunction run(a) {{}}\\nconst arrow', {k}, ' = async (x) => x') as content")
    return ingest.ruled_symbols(go.unionByName(rust).unionByName(script)).select("file_path", "language", "type", "label", "start_line")


def _web(spark, d):
    n = tg.table(spark, d, "nation")
    node = n.selectExpr("concat('src/r', n_nationkey, '.js') as file_path", "'javascript' as language", "concat('const x = 1\\napp.get(\\'/a', n_nationkey, '\\', auth, check, ctl.show);\\nrouter.post(\"/b\", save);') as content")
    django = n.selectExpr("concat('app', n_nationkey, '/urls.py') as file_path", "'python' as language", "concat('urlpatterns = [\\n  path(\\'x/', n_nationkey, '\\', views.show),\\n]') as content")
    return node.unionByName(django)


@query(
    """select 'src/r' || n_nationkey || '.js' as file_path, 'GET /a' || n_nationkey as label, 2 as start_line, 'node' as framework from nation union all select 'src/r' || n_nationkey || '.js', 'POST /b', 3, 'node' from nation
    union all select 'app' || n_nationkey || '/urls.py', 'ANY x/' || n_nationkey, 2, 'django' from nation""",
    graph=False,
)
def i7_routes(spark, d):
    return ingest.routes(_web(spark, d))[0].drop("id")


@query(
    """select coalesce(from_target, '') as from_target, relation, target, (select count(*) from nation) as n from (values (null, 'INVOKES', 'ctl.show'), (null, 'PASSES_THROUGH', 'auth'), ('auth', 'PASSES_THROUGH', 'check'), ('check', 'PASSES_THROUGH', 'ctl.show'), (null, 'INVOKES', 'save'), (null, 'INVOKES', 'views.show')) t(from_target, relation, target)""", graph=False
)
def i7_route_chains(spark, d):
    refs = ingest.routes(_web(spark, d))[1]
    return refs.groupBy(F.coalesce("from_target", F.lit("")).alias("from_target"), "relation", "target").agg(F.count("*").alias("n"))


@query(
    """select 'C' as kind, label, n from (values ('Suite.works', 1), ('it holds', 1)) t(label, k) cross join (select count(*) as n from nation) union all select 'S', label, n from (values ('clicked>save', 1), ('done>close', 1)) t(label, k) cross join (select count(*) as n from nation)""", graph=False
)
def i8_cpp_frameworks(spark, d):
    code = "'TEST_F(Suite, works) {}\\nTEST_CASE(\"it holds\", \"[x]\") {}\\nconnect(a, SIGNAL(clicked(int)), b, SLOT(save(int)));\\nconnect(a, &A::done, b, &ns::B::close);'"
    own = tg.table(spark, d, "nation").selectExpr("concat('t', n_nationkey, '.cpp') as file_path", "'cpp' as language", f"{code} as content")
    tests, signals = ingest.cpp_frameworks(own)
    told = tests.select(F.lit("C").alias("kind"), "label").unionByName(signals.select(F.lit("S").alias("kind"), F.concat_ws(">", "from_target", "target").alias("label")))
    return told.groupBy("kind", "label").agg(F.count("*").alias("n"))


@query(
    """select 'sh/s' || n_nationkey || '.comp' as shader, 0 as set_no, n_nationkey as binding, 'Cells' as name, 'src/m' || n_nationkey || '.cpp' as source_file from nation""", graph=False
)
def i9_v29_shader_bridge(spark, d):
    n = tg.table(spark, d, "nation")
    shaders = n.selectExpr("concat('sh/s', n_nationkey, '.comp') as file_path", "'glsl' as language", "concat('layout(binding = ', n_nationkey, ') buffer Cells { int c; };') as content")
    code = n.selectExpr("concat('src/m', n_nationkey, '.cpp') as file_path", "'cpp' as language", "concat('load(\"s', n_nationkey, '.comp.spv\");') as content")
    bindings, loads = ingest.shader_bridge(shaders.unionByName(code))
    return bindings.join(loads, "shader").select("shader", F.col("set").alias("set_no"), "binding", "name", "source_file")


@query("select relation, (select count(*) from nation) - case relation when 'LINKS' then 1 else 0 end as n from (values ('LINKS'), ('RUNS')) t(relation)", graph=False)
def i10_build_graph(spark, d):
    body = "concat('add_library(lib', n_nationkey, ' STATIC a.cpp)\\n# add_library(no b.cpp)\\nadd_executable(app', n_nationkey, ' main.cpp)\\ntarget_link_libraries(app', n_nationkey, ' PUBLIC lib', n_nationkey + 1, ' fmt::fmt)\\nadd_test(NAME t', n_nationkey, ' COMMAND app', n_nationkey, ')')"
    own = tg.table(spark, d, "nation").selectExpr("concat('d', n_nationkey, '/CMakeLists.txt') as file_path", "cast(null as string) as language", f"{body} as content")
    return ingest.build_graph(own)[1].groupBy("relation").agg(F.count("*").alias("n"))


@query(
    """select 'src/i' || n_nationkey || '.ts' as file_path, replace(local, '#', n_nationkey::varchar) as local, source, exported from nation cross join
    (values ('React', 'react', 'default'), ('used#', './a', 'use'), ('plain', './a', 'plain'), ('ns', './all', '*'), ('fs', 'fs', '*')) t(local, source, exported)""",
    graph=False,
)
def i11_import_evidence(spark, d):
    body = "concat('import React from \"react\";\\nimport {{ use as used', n_nationkey, ', plain }} from \"./a\";\\nimport * as ns from \"./all\";\\nconst fs = require(\"fs\");')".replace("{{", "{").replace("}}", "}")
    own = tg.table(spark, d, "nation").selectExpr("concat('src/i', n_nationkey, '.ts') as file_path", "'typescript' as language", f"{body} as content")
    return ingest.import_evidence(own)


@query("select n_nationkey, true as same_structure, n_nationkey % 2 = 0 as same_references from nation", graph=False)
def i12_r5_fingerprints(spark, d):
    """Two versions of each file: moved down a line, and every second one with another call."""
    n = tg.table(spark, d, "nation")

    def prints(first: str, call: str, name: str):
        nodes = n.selectExpr("concat('f', n_nationkey) as file_path", "'Function' as type", "'run' as qname", "'run(a)' as signature", f"{first} as start_line")
        refs = n.selectExpr("concat('f', n_nationkey) as source_file", "'CALLS' as relation", f"{call} as target", f"{first} as source_line")
        return ingest.file_fingerprints(nodes, refs).select("file_path", F.struct("structural", "dependency").alias(name))

    both = prints("1", "'x'", "a").join(prints("2", "if(n_nationkey % 2 = 0, 'x', 'y')", "b"), "file_path")
    return both.select(F.substring("file_path", 2, 9).cast("int").alias("n_nationkey"), (F.col("a.structural") == F.col("b.structural")).alias("same_structure"), (F.col("a.dependency") == F.col("b.dependency")).alias("same_references"))


@query("select 'f' || n_nationkey || '.py' as file_path, 'python' as language, 3 as lines, n_nationkey % 2 as imports_to, case when n_nationkey = 0 then (select count(*) from nation where n_nationkey % 2 = 1) else 0 end as imported_by, 'run,walk' as symbols from nation", graph=False)
def d11_structural_extract(spark, d):
    n = tg.table(spark, d, "nation").selectExpr("n_nationkey as k", "concat('f', n_nationkey, '.py') as file_path")
    nodes = n.selectExpr("file_path", "'Function' as type", "explode(array('walk', 'run', 'run')) as label")
    edges = n.filter("k % 2 = 1").selectExpr("'IMPORTS' as relation", "file_path as from_file", "'f0.py' as to_file")
    own = files.extract_of(nodes, edges, n.selectExpr("file_path", "'python' as language", "'a\\nb\\nc' as content"))
    return own.select("file_path", "language", "lines", F.col("imports_to").cast("int").alias("imports_to"), "imported_by", F.array_join("symbols", ",").alias("symbols"))


@query("select max(n) <= 20 and max(c) <= 100000 as fits, sum(n)::bigint as files from (select count(*) as n, 0 as c from documents group by doc_id)", graph=False)
def d11_batches(spark, d):
    docs = tg.table(spark, d, "documents").select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id")).alias("file_path"), F.length("text").cast("bigint").alias("chars"))
    own = files.batches(docs.filter("chars <= 50000").unionAll(docs.filter("chars > 50000"))).join(docs, "file_path").groupBy("batch").agg(F.count("*").alias("n"), F.sum("chars").alias("c"), F.max("chars").alias("most"))
    return own.agg((F.max("n") <= 20).alias("fits"), F.sum("n").alias("files")).select("fits", "files")


# Four languages, a file of each for every part; # stands for the part.
_SCOPED = {
    "ts": ("typescript", r"import { a } from './lib#';\nexport class Box# extends Base implements Shape {\n  run(a: string) {\n    return this.walk(\"}\") + helper#(a);\n  }\n}\nconst go# = async (a) => { deep(); };\n"),
    "go": ("go", r"package m\nimport \"fmt\"\ntype Box# struct { n int }\nfunc (b *Box#) Run(a int) {\n\tfmt.Println(\"{\")\n}\nfunc TestBox#(t *T) { Make() }\n"),
    "rs": ("rust", r"use a::b;\nstruct Box# { n: u8 }\nimpl Shape for Box# {\n  // fn no() {\n  fn area(&self) { self.side(); }\n}\nmod inner# { fn f() { g(); } }\n"),
    "rb": ("ruby", r"require 'set'\nmodule M#\n  class Box < Base\n    def run(a)\n      return helper(a) if a\n    end\n  end\nend\n"),
}


def _scoped(spark, d):
    # keys are dealt out before they become files: the table can be a single split
    parts = tg.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k")).repartition(4 * spark.sparkContext.defaultParallelism)
    one = lambda end, language, text: F.struct(F.concat(F.lit("src/m"), "k", F.lit(f".{end}")).alias("file_path"), F.lit(language).alias("language"), F.replace(F.lit(text.encode().decode("unicode_escape")), F.lit("#"), F.col("k")).alias("content"))
    return parts.select(F.inline(F.array(*[one(end, *told) for end, told in _SCOPED.items()])))


@query(
    """select 'src/m' || k || '.' || ending as file_path, type, 'src.m' || k || '.' || replace(qname, '#', k) as qname, a as start_line, b as end_line from (select p_partkey::varchar as k from part) cross join
    (values ('ts', 'Class', 'Box#', 2, 6), ('ts', 'Method', 'Box#.run', 3, 5), ('ts', 'Function', 'go#', 7, 7), ('go', 'Class', 'Box#', 3, 3), ('go', 'Method', 'Box#.Run', 4, 6), ('go', 'Test', 'TestBox#', 7, 7),
    ('rs', 'Class', 'Box#', 2, 2), ('rs', 'Method', 'Box#.area', 5, 5), ('rs', 'Module', 'inner#', 7, 7), ('rs', 'Function', 'inner#.f', 7, 7), ('rb', 'Module', 'M#', 2, 8), ('rb', 'Class', 'M#.Box', 3, 7), ('rb', 'Method', 'M#.Box.run', 4, 6)) t(ending, type, qname, a, b)""",
    graph=False,
)
def i2_scoped_symbols(spark, d):
    return scopes.scoped_symbols(_scoped(spark, d))[0].select("file_path", "type", "qname", "start_line", "end_line")


@query(
    """select 'src/m' || k || '.' || ending as source_file, relation, replace(target, '#', k) as target, a as source_line from (select p_partkey::varchar as k from part) cross join
    (values ('ts', 'IMPORTS', './lib#', 1), ('ts', 'EXTENDS', 'Base', 2), ('ts', 'EXTENDS', 'Shape', 2), ('ts', 'CALLS', 'Box#.walk', 4), ('ts', 'CALLS', 'helper#', 4), ('ts', 'CALLS', 'deep', 7), ('go', 'IMPORTS', 'fmt', 2), ('go', 'CALLS', 'Println', 5), ('go', 'TESTS', 'Make', 7),
    ('rs', 'IMPORTS', 'a::b', 1), ('rs', 'EXTENDS', 'Shape', 3), ('rs', 'CALLS', 'Box#.side', 5), ('rs', 'CALLS', 'g', 7), ('rb', 'IMPORTS', 'set', 1), ('rb', 'EXTENDS', 'Base', 3), ('rb', 'CALLS', 'helper', 5)) t(ending, relation, target, a)""",
    graph=False,
)
def i2_scoped_references(spark, d):
    return scopes.scoped_symbols(_scoped(spark, d))[1].select("source_file", "relation", "target", "source_line")
