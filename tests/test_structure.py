"""Structural counts and lineages against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strata.operators import ingest, temporal

NAME = "[A-Za-z_][A-Za-z0-9_]*"


def plain(s):
    """The fifteen counts, counted with Python's own patterns and lines."""
    s = s or ""
    lines = s.splitlines()
    imports = re.findall(r"^\s*(?:import\s+.+|from\s+\S+\s+import\s+.+|#include\s+[<\"][^>\"]+[>\"])", s, re.M)
    functions = {a or b or c for a, b, c in re.findall("|".join(ingest.FUNCTION_LINES), s, re.M)}
    words = {w for w in re.findall(r"\b[A-Za-z_][A-Za-z0-9_]{2,}\b", s) if w not in ingest.KEYWORDS}
    calls = [w for w in re.findall(rf"\b({NAME})\s*\(", s) if w not in ingest.KEYWORDS]
    loops, branches = len(re.findall(r"\b(?:for|while|do)\b", s)), len(re.findall(r"\b(?:if|switch|case|elif|else\s+if)\b", s))
    deepest = depth = 0
    for c in s:
        depth = depth + 1 if c == "{" else max(0, depth - 1) if c == "}" else depth
        deepest = max(deepest, depth)
    indent = max([(len(x) - len(x.lstrip(" "))) // 4 for x in lines if x.strip()], default=0)
    needed = set()
    for line in map(str.strip, imports):
        if line.startswith("#include"):
            needed.add(re.search(r"#include\s+[<\"]([^>\"]+)", line)[1])
        elif line.startswith("from "):
            needed.add(line.split()[1])
        elif line.startswith("import "):
            needed.add(line[7:].split(" as ")[0].split(",")[0].strip())
    needed.discard("")
    return [
        len(functions), len(set(re.findall(rf"^\s*(?:export\s+)?class\s+({NAME})", s, re.M))), 0, loops, branches, len(calls), len(imports), len(re.findall(r"\breturn\b", s)), max(deepest, indent), len(lines), len(words), any(s.count(f"{f}(") >= 2 for f in functions), 1 + loops + branches,
        sum(map(len, words)) / len(words) if words else 0.0, len(needed),
    ]


def test_structural_counts(spark):
    rng = random.Random(8)
    parts = ["import os, sys", "import a.b as c\n", "from x.y import (z", "#include <map>", "import React from 'react'", "function go(", "async function go (", "def go(", "  def é(", "x = (a, b) => ", "class A", "export class B {", "for", "while (", "do", "if (", "else if", "else\n if", "switch", "return go(1)", "éfor", "forä", "{", "}", "}}", "\n", "\n    ", "\r\n", "\n        y", "\x0b", "\x85", " ", "go(go(2))", "_a1_", "foo_bar", "if(", "new Thing(", "²if"[1:], "\t", "interface I", "`(`", "null(", "𝒳 ok"]
    sources = ["", None, " \n\n", "import x from 'y'\nfunction sum(a) { for (;;) { if (a) { b() } } }\n"] + ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "i int, s string").select("i", ingest.structure(F.col("s")).alias("m"))
    got = {r["i"]: r for r in df.select("i", "m.stats", "m.identifiers", ingest.feature_vector(F.col("m.stats")).alias("v"), ingest.feature_vector(F.col("m.stats"), 18).alias("w"), ingest.feature_vector(F.col("m.stats"), 4).alias("x")).collect()}
    for i, s in enumerate(sources):
        want = plain(s)
        assert list(got[i]["stats"])[:13] == want[:13] and got[i]["stats"][14] == want[14], repr(s)
        assert got[i]["stats"][13] == pytest.approx(want[13])
        assert got[i]["v"] == pytest.approx([float(x) for x in want], rel=1e-6) and got[i]["w"] == got[i]["v"] + [0.0] * 3 and got[i]["x"] == got[i]["v"][:4]
        assert got[i]["identifiers"] == sorted(got[i]["identifiers"])


def test_lineages_are_those_of_each_branch(spark):
    rows = [("p", f"b{i}", f"b{i - 1}" if i else None) for i in range(50)] + [("p", "x", "y"), ("p", "y", "x"), ("p", "self", "self"), ("p", "main", None), ("p", "lost", "nowhere"), ("q", "b3", "b2"), ("q", "b2", "main"), ("q", "main", None)]
    branches = spark.createDataFrame(rows, "projectId string, branch string, parentBranch string")
    got = {}
    for r in temporal.lineages(branches).collect():
        got.setdefault((r["projectId"], r["start"]), []).append((r["depth"], r["branch"]))
    for p, b, _ in rows:
        if b != "main":
            want = sorted((r["depth"], r["branch"]) for r in temporal.lineage(spark, branches, p, b).collect())
            assert sorted(got[p, b]) == want, (p, b)
