"""Small text extractors: shell, C, timing constraints, register files, IP-XACT.

Each is a set of column expressions over (uri, text) that gives rows (uri, kind,
name, detail); none needs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _found(files: DataFrame, kind: str, pattern: str, name: int = 1, detail: int | None = None) -> DataFrame:
    names = F.regexp_extract_all("text", F.lit(pattern), F.lit(name))
    details = F.regexp_extract_all("text", F.lit(pattern), F.lit(detail)) if detail is not None else F.transform(names, lambda _: F.lit(None).cast("string"))
    rows = files.select("uri", F.explode(F.arrays_zip(names.alias("n"), details.alias("d"))).alias("x"))
    return rows.select("uri", F.lit(kind).alias("kind"), F.trim("x.n").alias("name"), F.trim("x.d").alias("detail"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def shell(files: DataFrame) -> DataFrame:
    """BashFunction, BashVariable, BashScript (sourced files)."""
    return _union(
        [
            _found(files, "BashFunction", r"(?m)^[ \t]*(?:function[ \t]+)?([A-Za-z_]\w*)[ \t]*\(\)[ \t]*\{"),
            _found(files, "BashVariable", r"(?m)^[ \t]*(?:export[ \t]+|readonly[ \t]+|local[ \t]+)?([A-Za-z_]\w*)=([^\n#;]*)", 1, 2),
            _found(files, "BashScript", r"(?m)^[ \t]*(?:source|\.)[ \t]+([^\s;#]+)"),
        ]
    )


def c_sources(files: DataFrame) -> DataFrame:
    """CInclude, CFunction (definitions) and DPIBoundary (functions of a DPI import or export)."""
    return _union(
        [
            _found(files, "CInclude", r'(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"]+)[>"]'),
            _found(files, "CFunction", r"(?m)^(?:[A-Za-z_][\w \t*]*?[ \t*])([A-Za-z_]\w*)[ \t]*\(([^;{)]*)\)\s*\{", 1, 2),
            _found(files, "DPIBoundary", r'(?m)^[ \t]*(?:import|export)[ \t]+"DPI(?:-C)?"[^;\n]*?\b([A-Za-z_]\w*)[ \t]*(?:\([^;]*)?;'),
        ]
    )


def constraints(files: DataFrame) -> DataFrame:
    """ClockConstraint, IODelay, FalsePath, MulticyclePath, ClockGroup of Tcl-like timing constraints; continued lines are joined."""
    joined = files.select("uri", F.regexp_replace(F.regexp_replace("text", r"\\\n", " "), r"(?m)#.*$", "").alias("text"))
    return _union(
        [
            _found(joined, "ClockConstraint", r"(?m)^[ \t]*create_(?:generated_)?clock\b[^\n]*?-name[ \t]+\{?([\w./\[\]]+)\}?([^\n]*)", 1, 2),
            _found(joined, "IODelay", r"(?m)^[ \t]*set_(input|output)_delay\b([^\n]*)", 1, 2),
            _found(joined, "FalsePath", r"(?m)^[ \t]*(set_false_path)\b([^\n]*)", 1, 2),
            _found(joined, "MulticyclePath", r"(?m)^[ \t]*set_multicycle_path[ \t]+(\d+)([^\n]*)", 1, 2),
            _found(joined, "ClockGroup", r"(?m)^[ \t]*set_clock_groups\b[^\n]*?-group[ \t]+(\{[^}]*\}|\[[^\]]*\]|\S+)([^\n]*)", 1, 2),
        ]
    )


def ipxact(files: DataFrame) -> DataFrame:
    """IPXACT_Component, Port, BusInterface, Register, Field, Parameter by XPath; namespace prefixes are dropped first."""
    plain = files.select("uri", F.regexp_replace(F.regexp_replace("text", r"<(/?)\w+:", "<$1"), r"\sxmlns(:\w+)?=\"[^\"]*\"|\s\w+:\w+=\"[^\"]*\"", "").alias("text"))
    paths = {
        "IPXACT_Component": "/component/name/text()",
        "IPXACT_Port": "//ports/port/name/text()",
        "IPXACT_BusInterface": "//busInterfaces/busInterface/name/text()",
        "IPXACT_MemoryMap": "//memoryMaps/memoryMap/name/text()",
        "IPXACT_AddressBlock": "//addressBlock/name/text()",
        "IPXACT_Register": "//register/name/text()",
        "IPXACT_Field": "//field/name/text()",
        "IPXACT_Parameter": "//parameters/parameter/name/text()",
    }
    none = F.lit(None).cast("string").alias("detail")
    return _union([plain.select("uri", F.lit(kind).alias("kind"), F.explode(F.xpath("text", F.lit(path))).alias("name"), none) for kind, path in paths.items()])


def relaxed_json(text: Column) -> Column:
    """HJSON-like text to JSON: comments and trailing commas go, bare keys are quoted."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?m)(^|\s)(#|//).*$", ""), r"(?s)/\*.*?\*/", "")
    keyed = F.regexp_replace(bare, r'(?m)([{,]\s*|^\s*)([A-Za-z_]\w*)\s*:', r'$1"$2":')
    return F.regexp_replace(keyed, r",(\s*[}\]])", "$1")


REGISTERS = "name string, registers array<struct<name:string,desc:string,swaccess:string,fields:array<struct<bits:string,name:string,desc:string>>>>"


def registers(files: DataFrame) -> DataFrame:
    """CSR_Register and CSR_Field of register descriptions."""
    read = files.select("uri", F.from_json(relaxed_json(F.col("text")), REGISTERS, {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"}).alias("j"))
    rows = read.select("uri", F.col("j.name").alias("block"), F.explode("j.registers").alias("r"))
    top = rows.select("uri", F.lit("CSR_Register").alias("kind"), F.concat_ws(".", "block", "r.name").alias("name"), F.col("r.desc").alias("detail"))
    fields = rows.select("uri", "block", F.col("r.name").alias("reg"), F.explode("r.fields").alias("f"))
    return top.unionByName(fields.select("uri", F.lit("CSR_Field").alias("kind"), F.concat_ws(".", "block", "reg", "f.name").alias("name"), F.col("f.bits").alias("detail")))


TESTPLAN = "testpoints array<struct<name:string,desc:string,stage:string,tests:array<string>>>, covergroups array<struct<name:string,desc:string>>"


def testplan(files: DataFrame) -> DataFrame:
    """(uri, subject, predicate, object): has_stage, tests and collected_in of test plans."""
    read = files.select("uri", F.from_json(relaxed_json(F.col("text")), TESTPLAN).alias("j"))
    points = read.select("uri", F.explode("j.testpoints").alias("p"))
    stage = points.where("p.stage IS NOT NULL").select("uri", F.col("p.name").alias("subject"), F.lit("has_stage").alias("predicate"), F.col("p.stage").alias("object"))
    tests = points.select("uri", F.explode("p.tests").alias("subject"), F.col("p.name").alias("object")).select("uri", "subject", F.lit("tests").alias("predicate"), "object")
    groups = read.select("uri", F.explode("j.covergroups").alias("g")).select("uri", F.col("g.name").alias("subject"), F.lit("collected_in").alias("predicate"), F.col("uri").alias("object"))
    return stage.unionByName(tests).unionByName(groups)


def make_claims(files: DataFrame) -> DataFrame:
    """(uri, kind, name, detail): targets of makefiles with what they depend on."""
    return _found(files, "MakeTarget", r"(?m)^([A-Za-z0-9_./-]+)[ \t]*:(?!=)([^\n]*)", 1, 2)


def bazel_claims(files: DataFrame) -> DataFrame:
    """(uri, kind, name, detail): test rules of build files with their attributes."""
    return _found(files, "BazelTest", r'(?s)\b\w*_test\s*\(\s*name\s*=\s*"([^"]+)"([^)]*)\)', 1, 2)


def bind_tests(claims: DataFrame, modules: DataFrame) -> DataFrame:
    """(name, module, confidence_tier, resolved): test names (name, target) bound to modules (module).

    An exact name is high, a name that contains the module as a whole token medium; what finds none is bound to
    ``_unresolved.<target>`` with tier low.
    """
    names = modules.select(F.col("module"), F.lower("module").alias("key"))
    exact = claims.join(names, F.lower("target") == F.col("key")).select("name", "target", "module", F.lit("high").alias("confidence_tier"))
    tokens = claims.select("name", "target", F.explode(F.array_distinct(F.split(F.lower("name"), "[^a-z0-9]+"))).alias("key"))
    medium = tokens.join(names, "key").select("name", "target", "module", F.lit("medium").alias("confidence_tier")).join(exact.select("name", "module"), ["name", "module"], "left_anti")
    bound = exact.unionByName(medium.select(exact.columns))
    lost = claims.join(bound.select("name").distinct(), "name", "left_anti")
    rows = bound.withColumn("resolved", F.lit(True)).unionByName(lost.select("name", "target", F.concat(F.lit("_unresolved."), F.coalesce("target", F.lit("unknown"))).alias("module"), F.lit("low").alias("confidence_tier"), F.lit(False).alias("resolved")))
    return rows.select("name", "module", "confidence_tier", "resolved").distinct()
