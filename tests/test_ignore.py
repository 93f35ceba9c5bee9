"""Ignore rules against the documented behaviour of git."""

from __future__ import annotations

import re

import pytest

from assayer.operators import KEY, findings, ignore
from assayer.plans import scan

# One line per kind of rule in git's documentation of the format.
RULES = (
    "# generated\n\nout/\n!out/report.txt\n*.tmp\n!wanted.tmp\n/top.cfg\nlib/*.so\ncache/*\n!cache/index\n"
    "**/gen\nvendor/**\na/**/z\ndraft-?.md\nv[0-9].bin\n\\!literal\nspaced\\ name   \n"
)
IGNORED = [
    "out/report.txt", "x/out/deep/y", "n.tmp", "x/y/n.tmp", "top.cfg", "lib/one.so", "cache/blob", "cache/index.bak",
    "gen", "p/q/gen", "p/gen/inner", "vendor/one/two", "a/z", "a/b/c/z", "draft-1.md", "v7.bin", "!literal", "spaced name",
    "cache/more/index",
]
KEPT = [
    "outer/f", "wanted.tmp", "x/wanted.tmp", "x/top.cfg", "lib/sub/one.so", "cache/index", "generated.py", "vendor", "b/z",
    "draft-10.md", "vx.bin", "literal", "spaced name.txt",
]


def ignored(make_files, specs, paths):
    files = make_files(specs)
    tracked = make_files([(p, "") for p in paths])
    found = ignore.ignored_paths(tracked, ignore.ignore_specs(files)).collect()
    return {r["path"] for r in found}


def test_rule_table(make_files):
    assert ignored(make_files, [(".gitignore", RULES)], IGNORED + KEPT) == set(IGNORED)


@pytest.mark.parametrize(
    "rules, hits, misses",
    [
        ("config.json", ["b/config.json", "b/x/config.json"], ["config.json", "a/config.json"]),
        ("/x.txt\n!/y", ["b/x.txt"], ["b/c/x.txt", "b/y"]),
        ("[ab]c?.t[!x]t\n[z-a]q\n[oops", ["b/ac1.tyt"], ["b/cc1.tyt", "b/ac1.txt", "b/aq", "b/ac/.tyt"]),
        ("**/deep/x\nall/**", ["b/deep/x", "b/1/2/deep/x", "b/all/1/2"], ["b/all", "b/deep/y"]),
        ("\\#hash\n\\!bang\n# note\n\ntrail   \nsp\\ ace", ["b/#hash", "b/!bang", "b/trail", "b/sp ace"], ["b/# note", "b/hash"]),
        ("a+b(c).{1}$^|", ["b/a+b(c).{1}$^|"], ["b/aab(c).{1}$^|"]),
        ("*\n!*.md\n!keep/", ["b/x.py", "b/other/y.md"], ["b/x.md"]),
    ],
)
def test_rules_apply_below_their_directory(make_files, rules, hits, misses):
    assert ignored(make_files, [("b/.gitignore", rules)], hits + misses) == set(hits)


def test_regexes_compile():
    for rule in ("[]]x", "[a-]", "[!]a", "a[b", "\\", "é*", "[[:alpha:]]", "a&&b", "[a&&b]"):
        translated = ignore.ignore_regex(rule)
        assert translated is None or re.compile(translated[0])


@pytest.mark.parametrize("rule", ["logs/*", "logs/*?", "/logs/*", "logs/**", "*/x", "**/*"])
def test_parts_are_never_empty(rule):
    pattern = re.compile(ignore.ignore_regex(rule)[0])
    for candidate in ("", "/", "logs/", "logs//", "/x"):
        if rule != "**/*" or candidate in ("", "/"):
            assert not pattern.fullmatch(candidate), candidate


def test_star_keeps_what_is_taken_back(make_files):
    """Git looks below a directory whose entries are ignored one by one, not below an ignored one."""
    cases = {
        "logs/*\n!logs/keep.txt": {"logs/x"},
        "logs/\n!logs/keep.txt": {"logs/keep.txt", "logs/x"},
        "/*\n!/logs/": {"other"},
    }
    for rules, hits in cases.items():
        assert ignored(make_files, [(".gitignore", rules)], ["logs/keep.txt", "logs/x", "other"]) == hits


def axis(make_files, entries, extra=()):
    files = make_files(entries)
    tracked = make_files([*entries, *[(p, "") for p in extra]]).select(*KEY, "ord", "path")
    return findings.rank_findings(findings.merge_findings(scan.ignore_axis(files, tracked))).collect()


def test_findings_of_several_repositories(make_files):
    """One plan for many repositories: each gets its own verdict."""
    cases = {
        "none": [("app.py", "x = 1")],
        "empty": [(".gitignore", ""), ("app.py", "x = 1")],
        "open": [(".gitignore", "*.log\n"), (".env", "TOKEN=abc")],
        "covered": [(".gitignore", ".env\n"), (".env", "TOKEN=abc")],
        "negated": [(".gitignore", ".env*\n!.env.example\n"), (".env.example", "")],
        "reversed": [(".gitignore", "!.env.example\n.env.*\n"), (".env.example", "")],
        "node": [(".gitignore", ".env\n"), ("package.json", "{}"), ("src/app.js", "")],
        "nested": [("server/.gitignore", ".env\n__pycache__/\n.venv/\n"), ("server/app.py", "")],
        "partial": [("server/.gitignore", "__pycache__/\n.venv/\n"), ("server/app.py", "")],
        "itself": [(".gitignore", "*\n"), ("main.c", "")],
    }
    files = None
    for name, entries in cases.items():
        part = make_files(entries, repo=name)
        files = part if files is None else files.unionByName(part)
    found = findings.rank_findings(
        findings.merge_findings(scan.ignore_axis(files, files.select(*KEY, "ord", "path")))
    ).collect()
    seen = {name: set() for name in cases}
    for r in found:
        seen[r["repo"]].add((r["rule"].split(".")[1], r["severity"], r["evidence"]))
    missing = {("rule_missing", "medium", label) for label in (".env", "__pycache__", ".venv")}
    assert seen["none"] == {("missing", "high", "")}
    assert seen["empty"] == missing
    assert seen["open"] == {("unprotected", "critical", ".env"), ("rule_missing", "medium", ".env")}
    assert seen["covered"] == {("tracked_ignored", "high", ".env")}
    assert seen["negated"] == set()
    assert ("tracked_ignored", "medium", ".env.example") in seen["reversed"]
    assert seen["node"] == {("rule_missing", "medium", "node_modules")}
    assert seen["nested"] == set()
    assert seen["partial"] == {("rule_missing", "medium", ".env")}
    assert seen["itself"] == {("tracked_ignored", "medium", "main.c")}


def test_rules_meet_directories(spark):
    """A directory is a row, whatever stands below it; one of many entries is cut into several."""
    paths = [("r", "c", f"big/f{i}.log") for i in range(5000)] + [("r", "c", "a/b/c/d.txt"), ("r", "c", "top.txt")]
    frame = spark.createDataFrame(paths, "repo string, commit_sha string, path string")
    dirs, listed = ignore.directory_entries(frame)
    assert {r.dir for r in dirs.collect()} == {"", "big/", "a/", "a/b/", "a/b/c/"}
    sizes = {}
    for r in listed.collect():
        sizes.setdefault(r.dir, []).append(len(r.names))
    assert sizes[""] == [3] and sizes["a/"] == [1] and sizes["a/b/c/"] == [1]
    assert sum(sizes["big/"]) == 5000 and len(sizes["big/"]) == 5 and max(sizes["big/"]) < 1200
