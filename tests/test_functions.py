import json
import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import frontmatter, paths, properties


def column(spark, values, build):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.out for r in df.select("k", build(F.col("v")).alias("out")).orderBy("k").collect()]


def test_extension(spark):
    given = ["a/b.md", "a.", ".md", "a/b", "X.MD", "a.b/c", "x.tar.GZ", "", None]
    assert column(spark, given, paths.extension) == [".md", ".", ".md", "", ".md", "", ".gz", "", None]


def test_mime_type(spark):
    assert column(spark, [".md", ".canvas", ""], paths.mime_type) == ["text/markdown; charset=utf-8", "application/octet-stream", "application/octet-stream"]


def test_relative_paths(spark):
    given = ["/v/a.md", "/v/x/../b.md", "/v", "/w/a", "/va/b", "/v/./c//d", "/v/..x/y", "/"]
    relative = lambda p: paths.relative_path(paths.normalized(p), F.lit("/v"))
    assert column(spark, given, relative) == ["a.md", "b.md", ".", "../w/a", "../va/b", "c/d", "..x/y", ".."]
    assert column(spark, given, lambda p: paths.is_local(relative(p))) == [True, True, True, False, False, True, True, False]


def test_skipped_directories(spark):
    skip = frozenset({".obsidian"})
    given = [".obsidian/a.md", "x/.obsidian/y/a.md", "x/.obsidian.md", ".Obsidian/a", "a.md", "x/.obsidian"]
    assert column(spark, given, lambda p: paths.below_skipped(p, skip)) == [True, True, False, False, False, False]
    assert column(spark, given, lambda p: paths.first_skipped(p, skip)) == [".obsidian", "x/.obsidian", None, None, None, None]


def test_walk_order(spark):
    df = spark.createDataFrame([("a.md",), ("a/b.md",), ("a/a/z.md",), ("B.md",)], "p string")
    assert [r.p for r in df.orderBy(paths.walk_key(F.col("p"))).collect()] == ["B.md", "a/a/z.md", "a/b.md", "a.md"]


def test_repo_names(spark):
    assert column(spark, ["", ".", "..", "a/b", "a\\b", "My-Vault", "...", None], paths.valid_repo_name) == [False] * 5 + [True, True, False]


SPLITS = [
    ("# x\n", ("none", None, "# x\n", 0)),
    ("", ("none", None, "", 0)),
    ("﻿---\na: 1\n---\n", ("none", None, "﻿---\na: 1\n---\n", 0)),
    ("--- \na: 1\n---\n", ("none", None, "--- \na: 1\n---\n", 0)),
    ("---\n---\nbody", ("empty", "", "body", 2)),
    ("---\na: 1\n---\nbody\n", ("ok", "a: 1", "body\n", 3)),
    ("---\na: 1\nb: 2\n---\n", ("ok", "a: 1\nb: 2", "", 4)),
    ("---\n\n---\nbody", ("ok", "", "body", 3)),
    ("---\na: 1\n---", ("unterminated", None, None, None)),
    ("---\na: 1\n...\n", ("unterminated", None, None, None)),
    ("---\r\na: 1\r\n---\r\nx\ry", ("ok", "a: 1", "x\ry", 3)),
    ("---\n", ("unterminated", None, None, None)),
]


def test_split(spark):
    out = column(spark, [t for t, _ in SPLITS], lambda t: frontmatter.split(frontmatter.unix_lines(t)))
    assert [tuple(r) for r in out] == [e for _, e in SPLITS]


def by_hand(text):
    text = text.replace("\r\n", "\n")
    if not text.startswith("---\n"):
        return "none", None, text
    rest = text[4:]
    if rest.startswith("---\n"):
        return "empty", "", rest[4:]
    front, cut, body = rest.partition("\n---\n")
    return ("ok", front, body) if cut else ("unterminated", None, None)


def test_split_on_random_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["---", "\n", "\r\n", "a: b", " ", "\r", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    out = column(spark, texts, lambda t: frontmatter.split(frontmatter.unix_lines(t)))
    assert [tuple(r)[:3] for r in out] == [by_hand(t) for t in texts]


def test_bytes_that_are_not_text_are_kept(spark):
    df = spark.createDataFrame([(bytearray(b"---\na: 1\n---\n\xff\xfe"),)], "b binary")
    body = frontmatter.split(frontmatter.text_of(F.col("b")))["body"]
    assert df.select(body.cast("binary").alias("x")).first().x == b"\xff\xfe"


YAML = [
    ("title: memo\narchived: false\ntags: [project, go]\ncreated: 2026-09-01", {"title": "memo", "archived": False, "tags": ["project", "go"], "created": "2026-09-01T00:00:00Z"}),
    ("a: yes\nb: on\nc: 12:30:00\nd: 0o10\ne: 1e3\nf: 0777\ng: 0x1f\nh: ~\ni:", {"a": "yes", "b": "on", "c": "12:30:00", "d": 8, "e": 1000.0, "f": 511, "g": 31, "h": None, "i": None}),
    ('d: "2026-09-01"\ne: 2026-9-1\nf: 2001-12-14t21:59:43.10-05:00\ng: 2001-2-30', {"d": "2026-09-01", "e": "2026-09-01T00:00:00Z", "f": "2001-12-14T21:59:43.1-05:00", "g": "2001-2-30"}),
    ("links: {a: 1, b: {c: [1, 2.5, x]}}\n1: one", {"links": {"a": 1, "b": {"c": [1, 2.5, "x"]}}, "1": "one"}),
    ("x: &y {p: 1}\nz:\n  <<: *y\n  q: 2", {"x": {"p": 1}, "z": {"p": 1, "q": 2}}),
]


@pytest.mark.parametrize("text,expected", YAML)
def test_yaml(text, expected):
    found, problem = properties.parse(text)
    assert problem is None and json.loads(found) == expected
    assert found == json.dumps(expected, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


@pytest.mark.parametrize("text", ["a: 1\na: 2", "- 1\n- 2", "just text", "name: [unclosed", "? [a]\n: 1", "a: &b [*b]"])
def test_yaml_errors(text):
    found, problem = properties.parse(text)
    assert found is None and problem


@pytest.mark.parametrize("text", ["a: .nan\nb: 1", "a: -.inf", "a: !!binary aGk="])
def test_yaml_without_json_form(text):
    found, problem = properties.parse(text)
    assert json.loads(found)["a"] is None and problem


def test_yaml_column(spark):
    out = column(spark, ["a: 1", "", None, "- x", "# only a comment"], lambda t: properties.properties(t))
    assert [tuple(r) for r in out] == [('{"a":1}', None), (None, None), (None, None), (None, "front matter is not a mapping"), (None, None)]
