"""Rules against Python's own expressions, reports, configuration, command line and the registry's SQL."""

import datetime
import json
import random
import re
import xml.etree.ElementTree as ET

import __spark_entry__
import duckdb
import pytest
from vigilspark import cli, config
from vigilspark import rules as R
from vigilspark.functions import text as T
from vigilspark.operators import scan, stats
from vigilspark.plans import report
from vigilspark.plans.corpus import SEEDS
from vigilspark.sources import files as S
from vigilspark.streaming import stream_scan
from pyspark.sql import functions as F

EVERY = [r for rules in R.RULES.values() for r in rules]


def frame(spark, rows):
    return S.with_names(spark.createDataFrame([(p, len(c or ""), c) for p, c in rows], "path string, size long, content string"))


def in_python(rule, text):
    flags = re.M | re.I if rule.scanner in (R.SECRETS, R.CUSTOM) else 0
    found = re.findall(rule.pattern, text, flags)
    if rule.groups > 1:
        found = [str(m) if rule.scanner == R.SECRETS else " ".join(m) for m in found]
    return list(dict.fromkeys(found))


def test_catalogue():
    assert [len(R.RULES[k]) for k in (R.SECRETS, R.LLM, R.DEVSECOPS)] == [58, 18, 25]
    assert len({r.name for r in EVERY}) == 101
    assert R.severity_of("LLM - OpenAI API Key") == "LOW" and R.severity_of("LLM - OpenAI API Key", "declared") == "CRITICAL"
    assert R.severity_of("nothing") == "LOW"


def test_every_rule_as_in_python(spark):
    """All planted lines, and random mixtures with odd white space, accents and case, rule by rule."""
    rng = random.Random(6)
    noise = [" ", "\t", " ", "\x1c", "é", "ß", "K", "ſ", "٣", "²", "\n", "'", '"', ":", "=", "A", "-", "_", "."]
    texts = list(SEEDS) + [s.upper() for s in SEEDS] + [s.swapcase() for s in SEEDS]
    for _ in range(500):
        s = "".join(rng.choices(SEEDS, k=2))
        for _ in range(rng.randint(1, 4)):
            k = rng.randrange(len(s) + 1)
            s = s[:k] + rng.choice(noise) + s[k + rng.randint(0, 1) :]
        texts.append(s)
    docs = frame(spark, [(f"{i}", t) for i, t in enumerate(texts)])
    free = tuple(R.Rule(r.scanner, r.ord, r.name, r.pattern, r.severity, r.declared, r.gate) for r in EVERY)
    got = {}
    for r in scan.find(docs, free).orderBy("path", "rule", "match_ord").collect():
        got.setdefault((int(r.path), r.rule), []).append(r.match)
    want = {(i, r.name): m for i, t in enumerate(texts) for r in EVERY if (m := in_python(r, t))}
    wrong = [(k, got.get(k), want.get(k)) for k in set(got) | set(want) if got.get(k) != want.get(k)]
    assert not wrong, (len(wrong), wrong[:3])
    assert {n for _, n in want} == {r.name for r in EVERY}


def test_globs_names_and_pruning(spark):
    docs = frame(spark, [("main.tf", 'acl = "public-read"'), ("main.py", 'acl = "public-read"'), ("x.Dockerfile", "--privileged"), ("a/Dockerfile", "--privileged"), ("env/a.tf", 'acl = "public-read"'), ("i.png", "api_key"), ("n.py", None)])
    assert {r.path for r in scan.scan_devsecops(docs).collect()} == {"main.tf", "a/Dockerfile", "env/a.tf"}
    assert {r.path for r in docs.where(S.not_pruned(F.col("path"))).collect()} == {"main.tf", "main.py", "x.Dockerfile", "a/Dockerfile", "i.png", "n.py"}
    suffixes = {r.name: r.suffix for r in frame(spark, [(p, "") for p in (".env", "a.tar.GZ", "b", "c.py")]).collect()}
    assert suffixes == {".env": "", "a.tar.GZ": ".gz", "b": "", "c.py": ".py"}


def test_notebooks(spark):
    source = [('{"cells": [{"source": ["print(", "api_key)"]}, {"source": "eval(completion)"}, {}]}', "print(api_key)\neval(completion)"), ("no json", "no json"), ('{"x": 1}', "")]
    rows = spark.createDataFrame(source, "content string, want string")
    assert all(r.got == r.want for r in rows.select("want", S.notebook_text(F.col("content")).alias("got")).collect())


def test_entropy(spark):
    values = ["aabbccdd" * 4, "abcdefgh" * 4, "short", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(T.shannon_entropy(F.col("v"), T.BASE64)).collect()]
    assert got == [2.0, 3.0, 0.0, 5.0]
    mixed = "aB3dE5gH7jK9mN1pQ2rS4tU6vW8xY0zC"
    docs = frame(spark, [("a.py", f"x\npassword = '{mixed}'\nkey: '{mixed}'"), ("b.min.js", f"key='{mixed}'"), ("c.py", "key='" + "example" + mixed + "'")])
    rows = scan.scan_entropy(docs).collect()
    assert [(r.path, r.match) for r in rows] == [("a.py", f"entropy=5.0 charset=base64 line=2: {mixed}")]


def test_filters_and_merge(spark):
    docs = frame(spark, [("a.py", "pwd = qwerty\nx me@mail.org"), ("b.py", "-----BEGIN RSA " + "PRIVATE KEY-----")])
    every = scan.scan_secrets(docs)
    assert {tuple(r) for r in scan.at_least(every, "HIGH").collect()} == {tuple(r) for r in scan.scan_secrets(docs, "HIGH").collect()}
    assert scan.at_least(every, None).count() == every.count() == scan.merge(every, every).count()
    assert scan.new_since(every, scan.scan_secrets(docs, "HIGH")).count() == every.count() - scan.scan_secrets(docs, "HIGH").count()
    with pytest.raises(ValueError):
        scan.run_scan(docs, "other")
    assert {r.severity: r.n for r in stats.severity_by_match(every.limit(0)).collect()} == dict.fromkeys(R.LEVELS, 0)


def test_reports(spark):
    docs = frame(spark, [("d\\a.py", "pwd = qwerty\n<b> https://u:" + "p&q@h.example/<i>"), ("b.py", "azure storage account key = '" + "Ab1" * 29 + "A'")])
    found = scan.scan_secrets(docs)
    when = datetime.datetime(2020, 1, 2)
    out = json.loads(report.generate(found, "JSON", when=when))
    assert out["summary"]["total_files"] == 2 and out["findings"]["b.py"]["Azure Storage Key"]["matches"] == [["account", "key"]]
    root = ET.fromstring(report.generate(found, "xml", when=when).encode())
    assert root.find("Summary").get("totalFiles") == "2" and len(root.findall("Findings/File")) == 2
    sarif = json.loads(report.generate(found, "sarif", when=when))
    assert sarif["version"] == "2.1.0" and any(r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "d/a.py" for r in sarif["runs"][0]["results"])
    html = report.generate(found, "html", when=when)
    assert "&amp;q" in html and "<i>" not in html
    assert "**Password in Config** (MEDIUM): 1 match(es)" in report.generate(found, "md", when=when)
    assert "No security findings" in report.generate(found.limit(0), "html") and json.loads(report.generate(found.limit(0), "json"))["findings"] == {}
    assert json.loads(report.generate(found.limit(0), "sarif"))["runs"][0]["results"] == []
    with pytest.raises(ValueError):
        report.generate(found, "pdf")


def test_short_reports(spark):
    docs = frame(spark, [("d/a.py", "pwd = qwerty\n<b> https://u:" + "p&q@h.example/<i>"), ("b.py", "azure storage account key = '" + "Ab1" * 29 + "A'")])
    found, when = scan.scan_secrets(docs), datetime.datetime(2020, 1, 2)
    text = report.generate_short(found, "JSON", when=when)
    out, full = json.loads(text), json.loads(report.generate(found, "json", when=when))
    assert text == json.dumps(out, indent=2, ensure_ascii=False) and out["findings"] == full["findings"]
    assert out["summary"] == {k: v for k, v in full["summary"].items() if k != "severity_counts"}
    root = ET.fromstring(report.generate_short(found, "xml", when=when))
    assert set(root.attrib) == {"timestamp", "version"} and {x.tag for x in root} == {"File"} and root.find("Summary") is None
    listed = {(f.get("path"), c.get("name"), m.text) for f in root for c in f for m in c}
    assert listed == {(r.path, r.rule, r.match) for r in found.collect()}
    md = report.generate_short(found, "md", when=when)
    assert md.startswith("# 🔍 Secret Scan Report\n\n**Generated:** 2020-01-02T00:00:00\n\n## 📄 b.py\n- ") and "**Azure Storage Key** (" in md and "): [('account', 'key')]" in md
    none = found.limit(0)
    assert json.loads(report.generate_short(none, "json"))["findings"] == {} and len(ET.fromstring(report.generate_short(none, "xml"))) == 0
    with pytest.raises(ValueError):
        report.generate_short(found, "html")


def test_config():
    c = config.normalized(config.parse("severity_threshold: high\nscan_types:\n  - llm\n  - odd\ncustom_patterns:\n  \"A b\": 'x+'\nentropy:\n  enabled: yes\n  threshold: 4\nexclude_paths:\n  - a/*\n# note\nother:\n"))
    assert (c.severity_threshold, c.scan_types, c.custom_patterns, c.entropy.enabled, c.entropy.threshold, c.exclude_paths) == ("HIGH", ["llm"], {"A b": "x+"}, True, 4.0, ["a/*"])
    assert config.normalized([1]) == config.Config() == config.load("/nowhere")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.py").write_bytes("pwd = qwerty é\r\n".encode("latin-1"))
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "b.py").write_text("pwd = qwerty")
    out = tmp_path / "r.json"
    assert cli.main([str(tmp_path), "--format", "json", "-o", str(out)], spark) == 1
    assert list(json.loads(out.read_text())["findings"]) == ["sub/a.py"]
    out.unlink()
    assert cli.main([str(tmp_path), "--severity-threshold", "CRITICAL"], spark) == 0
    assert cli.main([str(tmp_path / "none")], spark) == 2
    assert cli.main([str(tmp_path / "sub" / "a.py"), "--format", "md", "-o", str(out)], spark) == 1


@pytest.mark.parametrize("name", ["secrets_findings", "llm_findings", "devsecops_findings", "entropy_values", "severity_counts_pairs", "custom_rules", "stream_findings"])
def test_as_in_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, sf_dir)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want.select(*columns).fetchall()))


def test_package_calls(spark, tmp_path):
    import vigilspark

    secret = "AKIA" + "ABCD" * 4
    (tmp_path / "a.py").write_text(f"id {secret}\n")
    assert vigilspark.findings_of(vigilspark.scan_file(spark, str(tmp_path / "none.py"))) == {}
    one = vigilspark.findings_of(vigilspark.scan_file(spark, str(tmp_path / "a.py")))
    assert [secret] in one.values()
    every = vigilspark.scan_directory(spark, str(tmp_path), "all")
    told = vigilspark.get_scan_stats(every)
    assert told["total_files"] == 1 and told["total_matches"] >= 1
    assert vigilspark.to_json(every, str(tmp_path / "r.json")).endswith("r.json") and secret in (tmp_path / "r.json").read_text()
    assert secret in vigilspark.generate_report(every, "md")


def test_every_infrastructure_rule_is_planted(spark):
    from vigilspark import rules
    from vigilspark.operators import scan
    from vigilspark.plans.corpus import files

    found = {r.rule for r in scan.scan_devsecops(files(spark, "/root/testdata/sf0.01")).select("rule").distinct().collect()}
    assert found == {r.name for r in rules.DEVSECOPS_RULES}


def test_stream_counts_by_window(spark, tmp_path):
    at = [datetime.datetime(2024, 1, 1, h, 30) for h in (0, 0, 1)]
    rows = [("a.py", 0, "AKIA" + "A" * 16, at[0]), ("b.py", 0, "AKIA" + "B" * 16 + " AKIA" + "C" * 16, at[1]), ("c.py", 0, "AKIA" + "D" * 16, at[2]), ("d.py", 0, None, at[2])]
    spark.createDataFrame([(p, p, ".py", *r) for p, *r in rows], "path string, name string, suffix string, size long, content string, arrived timestamp").write.parquet(str(tmp_path / "in"))
    arrived = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    rules = tuple(r for r in R.SECRET_RULES if r.name == "AWS Access Key")
    query = stream_scan.counts(arrived, rules).writeStream.format("memory").queryName("by_window").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.window.start, r.rule): r.matches for r in spark.table("by_window").collect()}
    assert got == {(datetime.datetime(2024, 1, 1, h), "AWS Access Key"): n for h, n in ((0, 3), (1, 1))}


def test_baseline_of_the_same_files_is_one_scan(spark, sf_dir):
    """both scans ran whole and met in a join."""
    docs = frame(spark, [("a.py", "pwd = qwerty\nx me@mail.org"), ("a.py", "-----BEGIN RSA " + "PRIVATE KEY-----"), ("main.tf", 'acl = "public-read" x@mail.org')])
    for kind, level, mode in (("all", "MEDIUM", "effective"), ("all", "CRITICAL", "declared"), ("secrets", "HIGH", "effective"), ("llm", "LOW", "effective"), ("all", "odd", "effective")):
        want = scan.new_since(scan.run_scan(docs, kind, mode=mode), scan.run_scan(docs, kind, threshold=level, mode=mode))
        assert sorted(map(str, scan.beyond(docs, kind, level, mode).collect())) == sorted(map(str, want.collect()))
    found = __spark_entry__.queries()["baseline_diff"](spark, sf_dir)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def _reads(found):
    return found._jdf.queryExecution().optimizedPlan().toString().count("parquet")


def test_merge_of_one_pass(spark, sf_dir):
    """the scans that replace others' findings ran twice or more, and met in joins."""
    rows = [("a", s, r, k, 0, f"{s}{k}", None) for k, (s, r) in enumerate([("secrets", "x"), ("llm", "x"), ("secrets", "y"), ("devsecops", "z"), ("llm", "z"), ("secrets", "x"), ("llm", "x")])]
    found = spark.createDataFrame(rows + [(None, "secrets", "x", 0, 0, "m", None), (None, "llm", "x", 0, 0, "m", None)], scan.FINDING)
    one, two, three = (found.where(F.col("scanner") == s) for s in ("secrets", "llm", "devsecops"))
    want = scan.merge(scan.merge(one, two), three)
    assert sorted(map(str, scan.merged(found, ("secrets", "llm", "devsecops")).select(want.columns).collect())) == sorted(map(str, want.collect()))
    query = __spark_entry__.queries()["merge_all"](spark, sf_dir)
    assert "Join" not in query._jdf.queryExecution().optimizedPlan().toString() and _reads(query) <= 2


def test_one_pass_of_all_scanners(spark, sf_dir):
    """F3 to F8: each scanner read the files, made their lower case and looked for its strings in whole texts by itself."""
    rng = random.Random(7)
    noise = [" ", "\t", "\n", "\r", "\x1c", "\x85", " ", "K", "ſ", "٣", "'", ":", "=", "@", "-", "_", "."]
    texts = []
    for _ in range(400):
        s = rng.choice(["", "\n", " "]).join(rng.choices(SEEDS[:-24], k=3))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(s) + 1)
            s = s[:k] + rng.choice(noise) + s[k + rng.randint(0, 1) :]
        texts.append(s)
    names = ("a.py", "b.tf", "Dockerfile", "c.yaml", "run.sh", "docker-compose.yml", "n.ipynb", "i.png", "page.html")
    docs = frame(spark, [(f"{i}/{names[i % len(names)]}", t) for i, t in enumerate(texts)])
    apart = scan.scan_secrets(docs).unionByName(scan.scan_llm(docs)).unionByName(scan.scan_devsecops(docs))
    every = scan.run_scan(docs, "all").collect()
    assert sorted(map(str, every)) == sorted(map(str, apart.collect()))
    got = {}
    for r in sorted(every, key=lambda r: r.match_ord):
        got.setdefault((r.path, r.rule), []).append(r.match)
    want = {(f"{i}/{names[i % len(names)]}", r.name): m for i, t in enumerate(texts) for r in R.SECRET_RULES if names[i % len(names)] != "i.png" and (m := in_python(r, t))}
    own = {k: v for k, v in got.items() if k[1] in {r.name for r in R.SECRET_RULES}}
    wrong = [(k, own.get(k), want.get(k)) for k in set(own) | set(want) if own.get(k) != want.get(k)]
    assert not wrong, (len(wrong), wrong[:3])
    for r in EVERY:
        for t in texts:
            for m in re.finditer(r.pattern, t, re.M | re.I if r.scanner == R.SECRETS else 0):
                assert not r.needs or any(n in m[0].lower() for n in r.needs), (r.name, m[0])
                assert not r.lines or "\n" not in m[0], (r.name, m[0])
    for name in ("report_xml", "report_html", "sarif_results", "report_json", "severity_counts_matches", "report_sarif"):
        assert _reads(__spark_entry__.queries()[name](spark, sf_dir)) <= 2, name
