"""Lifts, extractors, connectors, exports, the vocabulary and the one-line query form."""

import json

import pytest
from pyspark.sql import functions as F

from cairngraph.functions.vocabulary import Vocabulary, VocabularyError
from cairngraph.operators import connectors as C
from cairngraph.plans import dsl
from cairngraph.sources import export, extractors, python_lift


def files(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "uri string, text string")


def names(df, kind=None):
    return sorted((r.name, r.detail) if kind is None else r.name for r in df.collect() if kind in (None, r.kind))


SOURCE = '''
__all__ = ["f"]
import os as o
from .a import b as c
type T = int
@dataclass
class K(Base, metaclass=M):
    @property
    def p(self):
        return [x for x in y if (z := x)]
async def f(a): return lambda q: q
match 1:
    case 1: pass
'''


def test_python_lift(spark):
    rows = python_lift.lift_files(files(spark, a=SOURCE, bad="def (")).collect()
    kinds = {r.kind for r in rows if r.uri == "a"}
    assert kinds == {"PyModule", "PyImport", "PyTypeAlias", "PyClass", "PyFunction", "PyComprehension", "PyLambda", "PyMatchStatement"}
    by = {(r.kind, r.name): (r.ordinal, r.parent, json.loads(r.payload)) for r in rows if r.uri == "a"}
    assert by["PyModule", ""][2] == {"all_exports": ["f"]}
    assert by["PyFunction", "p"][1] == by["PyClass", "K"][0] and by["PyFunction", "p"][2]["has_walrus"] and by["PyFunction", "f"][2]["is_async"]
    assert by["PyClass", "K"][2] == {"decorators": ["dataclass"], "bases": ["Base"], "keywords": {"metaclass": "M"}}
    assert [r.kind for r in rows if r.uri == "bad"] == ["PyError"]


@pytest.mark.parametrize("consumer,level,module,package,want", [("a.b.c", 1, "d", False, "a.b.d"), ("a.b", 1, "d", True, "a.b.d"), ("a", 3, "d", False, None), ("a.b", 2, "", False, None), ("a", 0, "x.y", False, "x.y")])
def test_relative_imports(consumer, level, module, package, want):
    assert python_lift.resolve_relative(consumer, level, module, package) == want


def test_module_names():
    assert python_lift.module_name("src/pkg/sub/m.py", {"src/pkg", "src/pkg/sub"}) == "pkg.sub.m"
    assert python_lift.module_name("src/pkg/__init__.py", {"src/pkg"}) == "pkg"


def test_extractors(spark):
    sh = extractors.shell(files(spark, s="#!/bin/sh\nexport A=1\nf() {\n  local x=2\n}\nsource lib.sh\n"))
    assert names(sh, "BashFunction") == ["f"] and names(sh, "BashVariable") == ["A", "x"] and names(sh, "BashScript") == ["lib.sh"]
    c = extractors.c_sources(files(spark, c='#include <a.h>\nint add(int a, int b) {\n return a; }\nimport "DPI-C" function int go(input int x);\n'))
    assert names(c, "CInclude") == ["a.h"] and names(c, "CFunction") == ["add"] and names(c, "DPIBoundary") == ["go"]
    sdc = extractors.constraints(files(spark, t="create_clock -name clk \\\n -period 5 [get_ports c]\nset_input_delay 2 -clock clk d\nset_false_path -from a -to b\nset_multicycle_path 2 -to x\n"))
    assert names(sdc, "ClockConstraint") == ["clk"] and names(sdc, "IODelay") == ["input"] and names(sdc, "MulticyclePath") == ["2"] and len(names(sdc, "FalsePath")) == 1
    xml = '<ipxact:component xmlns:ipxact="http://x"><ipxact:name>uart</ipxact:name><ipxact:model><ipxact:ports><ipxact:port><ipxact:name>clk</ipxact:name></ipxact:port></ipxact:ports></ipxact:model></ipxact:component>'
    ip = extractors.ipxact(files(spark, x=xml))
    assert names(ip, "IPXACT_Component") == ["uart"] and names(ip, "IPXACT_Port") == ["clk"]
    h = extractors.registers(files(spark, r='{ // block\n name: "uart", registers: [ { name: "CTRL", desc: "control", fields: [ {bits: "0", name: "EN"}, ] }, ] }'))
    assert names(h, "CSR_Register") == ["uart.CTRL"] and names(h, "CSR_Field") == ["uart.CTRL.EN"]
    plan = extractors.testplan(files(spark, p='{testpoints: [{name: "smoke", stage: "V1", tests: ["t1"]}], covergroups: [{name: "cg"}]}'))
    assert {(r.subject, r.predicate, r.object) for r in plan.collect()} == {("smoke", "has_stage", "V1"), ("t1", "tests", "smoke"), ("cg", "collected_in", "p")}
    assert names(extractors.make_claims(files(spark, m="all: a b\n\techo\nX := 1\n"))) == [("all", "a b")]
    assert names(extractors.bazel_claims(files(spark, b='cc_test(name = "t", srcs = ["a.c"])')), "BazelTest") == ["t"]


def test_bind_tests(spark):
    claims = spark.createDataFrame([("t1", "uart"), ("uart_smoke", "x"), ("lost", "y")], "name string, target string")
    got = {(r.name, r.module, r.confidence_tier, r.resolved) for r in extractors.bind_tests(claims, spark.createDataFrame([("UART",)], "module string")).collect()}
    assert got == {("t1", "UART", "high", True), ("uart_smoke", "UART", "medium", True), ("lost", "_unresolved.y", "low", False)}


def test_registry_and_connectors(spark):
    r = C.Registry()
    r.register("a", C.Connector("a", ("sv",), lambda n, e: C.self_references(n)))
    with pytest.raises(ValueError):
        r.register("a", object())
    with pytest.raises(KeyError):
        r.get("b")
    nodes = spark.createDataFrame([("n", "sv", "semantic"), ("m", "sv", "token")], "id string, source string, category string")
    edges = spark.createDataFrame([("x", "y", "E")], "src string, dst string, type string")
    assert {tuple(e) for e in C.run_connectors(r, nodes, edges).collect()} == {("x", "y", "E"), ("n", "n", "CONTAINS")}
    with pytest.raises(ValueError):
        C.run_connectors(r, nodes.withColumn("source", F.lit("py")), edges)
    assert C.extract(r, "a", "c", []) is None


def test_roles(spark):
    d = spark.createDataFrame(
        [("k", "PyClass", ["_dc(frozen=True)"], {"_dc": "dataclasses.dataclass"}), ("f", "PyFunction", ["other", "pytest.fixture()"], {}), ("g", "PyFunction", ["dataclass"], {}), ("h", "PyFunction", ["ft.cached_property"], {"ft": "functools"})],
        "id string, kind string, decorators array<string>, aliases map<string,string>",
    )
    assert {tuple(r) for r in C.decorator_roles(d).collect()} == {("k", "dataclass"), ("f", "fixture")}
    assert {tuple(r) for r in C.property_descriptors(d).collect()} == {("h", "property-descriptor")}
    classes = spark.createDataFrame([("A", "A", "m.A", []), ("B", "B", "m.B", ["m.A"]), ("C", "C", "m.C", ["x.B"]), ("D", "D", "m.D", ["D"])], "id string, name string, qualname string, bases array<string>")
    methods = spark.createDataFrame([("A", "__get__")], "class_id string, name string")
    assert {r.id for r in C.method_roles(classes, methods, "__get__", "descriptor").collect()} == {"A", "B", "C"}
    assert {r.id for r in C.method_roles(classes, methods, "__get__", "descriptor", chase_bases=False).collect()} == {"A"}
    known = spark.createDataFrame([("A", "first")], "id string, role string")
    assert {tuple(r) for r in C.add_roles(known, spark.createDataFrame([("A", "second"), ("B", "x")], "id string, role string")).collect()} == {("A", "first"), ("B", "x")}


def test_post_passes(spark):
    types = spark.createDataFrame([("t1", "byte_t")], "id string, name string")
    rows = C.of_type_edges(spark.createDataFrame([("s", "byte_t"), ("u", "gone_t")], "id string, type_name string"), types)
    assert {(r.src, r.dst) for r in rows.collect()} == {("s", "t1"), ("u", "_unresolved.gone_t")}
    signals = spark.createDataFrame([("1", "top.a", "a"), ("2", "sub.a", "a"), ("3", "sub.b", "b")], "id string, path string, name string")
    checks = C.checks_edges(spark.createDataFrame([("x", "sub", "a"), ("y", "far", "b"), ("z", "far", "a")], "id string, scope string, name string"), signals)
    assert {(r.src, r.dst) for r in checks.collect()} == {("x", "2"), ("y", "3")}


def test_capture_resolution(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    captures = frame([(1, "u", "f", "x"), (2, "u", "f", "imp"), (3, "u", "f", "mod"), (4, "u", "f", "own"), (5, "u", "f", "len"), (6, "u", "f", "zzz")], "capture_id int, uri string, scope string, name string")
    got = C.resolve_captures(
        captures, frame([("u", "f", "x")], "uri string, scope string, name string"), frame([("u", "own", "id1")], "uri string, name string, id string"),
        frame([("u", "imp", "lib", "thing"), ("u", "mod", "lib", None)], "uri string, name string, module string, item string"), frame([("lib", "thing", "id2")], "module string, item string, id string"),
    )
    assert {r.capture_id: (r.resolution, r.target) for r in got.collect()} == {
        1: ("local-in-enclosing", None), 2: ("cross-file-import", "id2"), 3: ("module-import", "lib"), 4: ("module-level", "id1"), 5: ("builtin", None), 6: ("unresolved", None),
    }


def test_code_references(spark):
    snippets = spark.createDataFrame([("s1", "c", "inline", " fifo "), ("s2", "c", "fence", "use fifo_ctl; fifo x"), ("s3", "d", "inline", "fifo")], "id string, corpus string, kind string, text string")
    got = C.code_references(snippets, spark.createDataFrame([("n", "c", "fifo")], "id string, corpus string, name string"))
    assert {(r.src, r.dst) for r in got.collect()} == {("s1", "n"), ("s2", "n")}


def test_exports(spark, tmp_path):
    entities = spark.createDataFrame([("a", "T", 100, None), ("b", None, 1, "ast")], "name string, type string, mention_count int, layer string")
    edges = spark.createDataFrame([("a", "uses", "b")], "subject string, predicate string, object string")
    pages = {r.name: r.page for r in export.note_pages(entities, edges).collect()}
    assert "- uses: [[b]]" in pages["a"] and "- [[a]] (uses)" in pages["b"]
    nodes = export.drawing_nodes(entities)
    assert [(r.key, r["size"]) for r in nodes.collect()] == [("a", 20)]
    assert export.drawing(export.drawing_nodes(entities, ()), edges).count() == 3
    g = spark.createDataFrame([("a", "b", "E"), ("b", "a", "F")], "src string, dst string, type string")
    export.save_graph(entities, g, str(tmp_path / "g"))
    n, e = export.load_graph(spark, str(tmp_path / "g"))
    assert n.count() == 2 and e.where("type = 'E'").select("src", "dst").collect()[0] == ("a", "b")
    (tmp_path / "nl.json").write_text('{"nodes": [{"id": "a"}], "links": [{"source": "a", "target": "a"}]}')
    n, e = export.read_node_link(spark, str(tmp_path / "nl.json"))
    assert n.count() == e.count() == 1


def test_vocabulary(spark):
    v = Vocabulary.read('{"nodes": {"M": 1, "P": 2}, "edges": {"HAS": {"sources": ["M"], "targets": ["P"]}, "LOOP": {"sources": ["M"], "targets": ["M"]}, "PP": {"sources": ["P"], "targets": ["P"]}}, "legacy": {"Mod": "M"}}')
    assert v.active(1) == {"M"} and v.check_patterns([["HAS", "PP"]]) == [] and len(v.check_patterns([["LOOP", "PP"]])) == 1
    with pytest.raises(VocabularyError):
        v.check_edge_types(["HAS", "NONE"])
    nodes = v.modernise(spark.createDataFrame([("m", "Mod"), ("p", "P")], "id string, kind string"))
    edges = spark.createDataFrame([("m", "p", "HAS"), ("p", "m", "HAS"), ("m", "p", "X")], "src string, dst string, type string")
    assert {(r.src, r.type, r.reason) for r in v.violations(nodes, edges).collect()} == {("p", "HAS", "source not allowed"), ("m", "X", "unknown type")}


def test_query_lines(spark):
    nodes = spark.createDataFrame([("a", "module", "top"), ("b", "port", "x"), ("c", "port", "y")], "id string, role string, name string")
    edges = spark.createDataFrame([("a", "b", "HAS"), ("b", "c", "DRIVES")], "src string, dst string, type string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(dsl.run_line("role=port name=x", nodes, edges)) == ["b"]
    assert ids(dsl.run_line("from=c via=DRIVES,HAS depth=2 direction=rev", nodes, edges)) == ["a", "b", "c"]
    assert ids(dsl.run_line("file=q", nodes, edges)) == []
    assert ids(dsl.run_canned({"kind": "path", "from": "a", "to": "c", "via": ["HAS", "DRIVES"], "depth": 4}, nodes, edges)) == ["a", "b", "c"]
    assert ids(dsl.run_canned({"kind": "filter", "where": {"role_in": ["port"]}}, nodes, edges)) == ["b", "c"]
    for bad in ("", "x", "depth=a", "direction=up", "colour=red"):
        with pytest.raises(ValueError):
            dsl.parse(bad)
    found, walked = dsl.walk(nodes, edges, ["a"], ["HAS"], 1)
    assert ids(found) == ["a", "b"] and walked.count() == 1


def test_golden(spark):
    text = json.dumps([{"id": "1", "question": "q", "gold_entities": ["a", "b"], "gold_answer": "x"}, {"id": "2", "question": "q", "gold_entities": ["a"], "gold_answer": "x"}])
    golden = dsl.golden_questions(spark, text)
    scored = {r.id: (r.precision, r.recall) for r in dsl.evaluate(golden, spark.createDataFrame([("1", ["a"])], "id string, predicted array<string>")).collect()}
    assert scored == {"1": (1.0, 0.5), "2": (0.0, 0.0)}
    with pytest.raises(ValueError):
        dsl.golden_questions(spark, '[{"id": "1"}]')
