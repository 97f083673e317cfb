"""Registered supply-chain and document queries; files are built from the given tables."""

from __future__ import annotations

import html
import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from callwarden.operators import documents as G
from callwarden.operators import supply as U
from callwarden.plans.content_queries import _JUDGED, _VARIANTS, _holds_pii
from callwarden.plans.registry import query
from callwarden.plans.views import view
from callwarden.sources.tables import spread


def _pickles(spark, sf_dir):
    """One file per part: an opcode stream that imports a name, or damaged bytes."""
    module = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'os\nsystem' WHEN 1 THEN 'collections\nOrderedDict' WHEN 2 THEN 'subprocess\nPopen' "
                    "WHEN 3 THEN 'builtins\neval' ELSE 'builtins\nlist' END")
    stream = F.concat(F.unhex(F.lit("8002")), F.concat(F.lit("c"), module, F.lit("\n")).cast("binary"), F.unhex(F.lit("2E")))
    content = F.when(F.col("p_partkey") % 11 == 0, F.unhex(F.lit("80025D"))).otherwise(stream)
    return spread(view(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(".pkl")).alias("name"), content.alias("content"))


@query("scan_pickles", """
SELECT p_partkey AS id, 'ATK-PICKLE-001' AS rule_id, CASE WHEN p_partkey % 11 = 0 THEN '<malformed-pickle>' WHEN p_partkey % 5 = 0 THEN 'os.system'
  WHEN p_partkey % 5 = 2 THEN 'subprocess.Popen' ELSE 'builtins.eval' END AS globals FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 5 IN (0, 2, 3)""")
def scan_pickles(spark, sf_dir):
    return U.scan_pickles(_pickles(spark, sf_dir)).select("id", "rule_id", F.array_join("globals", ",").alias("globals"))


_PKG = "concat(cast(p_size % 3 AS string), '.', cast(p_partkey % 4 AS string), '.', cast(p_partkey % 100 AS string))"


@query("vulnerable_components", f"""
WITH p AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'llama-cpp-python' ELSE 'other' END AS package, {_PKG} AS version,
  p_size % 3 AS a, p_partkey % 4 AS b, p_partkey % 100 AS c FROM part)
SELECT id, package, version, '0.2.72' AS fixed_in FROM p WHERE package = 'llama-cpp-python' AND (a < 0 OR (a = 0 AND (b < 2 OR (b = 2 AND c < 72))))""")
def vulnerable_components(spark, sf_dir):
    packages = view(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "CASE WHEN p_size % 2 = 0 THEN 'llama-cpp-python' ELSE 'other' END AS package", f"{_PKG} AS version")
    advisories = spark.createDataFrame([(r["id"], r["package"], r["version_lt"]) for r in U._rows("component", None)],
                                       "rule_id string, package string, version_lt string")
    return U.vulnerable_components(packages, advisories).drop("rule_id")


@query("scan_templates", """
SELECT page_id AS id FROM pages WHERE regexp_matches(concat(html, CASE page_id % 4 WHEN 0 THEN '{{ x.__class__ }}' WHEN 1 THEN 'os.popen' ELSE 'osXpopen' END),
  '__class__|__globals__|__subclasses__|__builtins__|__import__|os\\.popen|subprocess')""")
def scan_templates(spark, sf_dir):
    t = F.concat("html", F.expr("CASE page_id % 4 WHEN 0 THEN '{{ x.__class__ }}' WHEN 1 THEN 'os.popen' ELSE 'osXpopen' END"))
    return U.scan_templates(view(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), t.alias("template"))).select("id")


_URL = """CASE page_id % 5 WHEN 0 THEN 'https://huggingface.co/a' WHEN 1 THEN 'https://hugginface.co/a' WHEN 2 THEN 'https://cdn.ollama.com/x'
  WHEN 3 THEN 'olama.com' ELSE url END"""


@query("check_sources", f"""
WITH h AS (SELECT page_id AS id, lower(coalesce(nullif(regexp_extract({_URL}, '^[a-z]+://([^/?#:]+)', 1), ''), {_URL})) AS host FROM pages),
n AS (SELECT *, list_filter(['huggingface.co', 'ollama.com', 'registry.ollama.ai'], lambda a: levenshtein(host, a) <= 2) AS near FROM h
  WHERE host NOT IN ('huggingface.co', 'ollama.com', 'registry.ollama.ai') AND NOT (host LIKE '%.huggingface.co' OR host LIKE '%.ollama.com' OR host LIKE '%.registry.ollama.ai'))
SELECT id, host, CASE WHEN len(near) > 0 THEN 'typosquat' ELSE 'non_allowlisted_host' END AS kind, array_to_string(near, ',') AS looks_like FROM n""")
def check_sources(spark, sf_dir):
    models = view(spark, sf_dir, "pages").selectExpr("page_id AS id", f"{_URL} AS url")
    return U.check_sources(models).select("id", "host", "kind", "looks_like")


@query("check_pins", """
SELECT concat('doc/', cast(doc_id AS string)) AS key, sha256(text) AS sha256,
  CASE WHEN doc_id % 4 = 0 THEN 'MODEL-HASH-002' WHEN doc_id % 4 = 1 THEN 'MODEL-HASH-001' ELSE 'MODEL-HASH-OK' END AS rule_id FROM documents""")
def check_pins(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("key"), F.col("text").cast("binary").alias("content"))
    good = F.concat(F.lit("sha256:"), F.upper(F.sha2("content", 256)))
    pins = docs.where(F.col("doc_id") % 4 != 0).select("key", F.when(F.col("doc_id") % 4 == 1, F.sha2(F.lit(b"other"), 256)).otherwise(good).alias("pin"))
    return U.check_pins(docs, pins, require_pinned=True)


_SNAP = "SELECT p_brand AS name, p_partkey AS seq, cast(p_size % 3 AS string) AS v FROM part"


@query("tool_drift", f"""
WITH RECURSIVE s AS (SELECT name, seq, v, seq % 17 = 0 AS approve, row_number() OVER (PARTITION BY name ORDER BY seq) AS rn FROM ({_SNAP})),
w AS (SELECT name, seq, v, rn, v AS pinned, cast(NULL AS VARCHAR) AS pending, 'approved' AS status, false AS event, approve FROM s WHERE rn = 1
  UNION ALL
  SELECT s.name, s.seq, s.v, s.rn, CASE WHEN w.approve THEN w.v ELSE w.pinned END,
    CASE WHEN s.v <> CASE WHEN w.approve THEN w.v ELSE w.pinned END THEN s.v WHEN w.approve THEN NULL ELSE w.pending END,
    CASE WHEN s.v <> CASE WHEN w.approve THEN w.v ELSE w.pinned END OR (NOT w.approve AND w.status = 'quarantined') THEN 'quarantined' ELSE 'approved' END,
    s.v <> CASE WHEN w.approve THEN w.v ELSE w.pinned END AND (w.approve OR w.pending IS NULL OR w.pending <> s.v), s.approve
  FROM w JOIN s ON s.name = w.name AND s.rn = w.rn + 1)
SELECT name, seq, status, event FROM w""")
def tool_drift(spark, sf_dir):
    snapshots = spark.sql(_SNAP.replace("FROM part", "FROM {part}"), part=view(spark, sf_dir, "part")).select(
        "name", "seq", U.definition_hash(F.to_json(F.struct("name", "v"))).alias("hash"))
    approvals = snapshots.where(F.col("seq") % 17 == 0).select("name", "seq")
    return U.tool_drift(snapshots, approvals).select("name", "seq", "status", "event")


@query("register_models", """
WITH m AS (SELECT p_partkey AS id, p_partkey % 11 = 0 OR p_partkey % 5 IN (0, 2, 3) AS pickled, p_size % 7 = 0 AS hash FROM part)
SELECT id, NOT (pickled OR hash) AS accepted, CASE WHEN pickled THEN 'ATK-PICKLE-001' WHEN hash THEN 'MODEL-HASH-001' END AS rule_id FROM m""")
def register_models(spark, sf_dir):
    parts = view(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    pickled = U.scan_pickles(_pickles(spark, sf_dir)).withColumn("ord", F.lit(3))
    hashes = parts.where("p_size % 7 = 0").select("id", F.lit("MODEL-HASH-001").alias("rule_id"), F.lit(4).alias("ord"))
    return U.register_models(parts, pickled, hashes)


# ---------------------------------------------------------------- documents


@F.pandas_udf(BinaryType())
def _docx(key: pd.Series, text: pd.Series) -> pd.Series:
    """A Word file per text: lines as paragraphs, a hidden run, a comment, a property, and for some a remote template."""

    def build(k: int, t: str) -> bytes:
        esc = html.escape(t, quote=False)
        paras = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in esc.split("\n"))
        hidden = f"<w:p><w:r><w:rPr><w:vanish/></w:rPr><w:t>hidden note {k}</w:t></w:r></w:p>"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", f"<w:document>{paras}{hidden}</w:document>")
            z.writestr("word/comments.xml", f'<w:comment w:id="1" w:author="Ann"><w:p><w:t>key AKIA{k:016d}</w:t></w:p></w:comment>')
            z.writestr("docProps/core.xml", f"<cp:x><dc:subject>topic {k}</dc:subject><dcterms:created>2024</dcterms:created></cp:x>")
            if k % 3 == 0:
                z.writestr("word/_rels/settings.xml.rels", '<Relationship Id="r1" Type="http://x/attachedTemplate" Target="https://evil.example/t.dotm" TargetMode="External"/>')
            if k % 4 == 0:
                z.writestr("word/vbaProject.bin", b"x")
        return out.getvalue()

    return pd.Series([build(int(k), t) for k, t in zip(key, text)])


def _office(spark, sf_dir):
    return view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), _docx("doc_id", "text").alias("content"))


_SQUEEZE = "regexp_replace({0}, '[ \\n\\t\\r]', '', 'g')"


@query("extract_ooxml", f"""
SELECT doc_id AS id, 'docx' AS kind, md5({_SQUEEZE.format("text")}) AS body_digest,
  concat('hidden text (w:vanish)=hidden note ', cast(doc_id AS string), '|comment by Ann=key AKIA', lpad(cast(doc_id AS string), 16, '0'), '|document properties: subject=topic ',
    cast(doc_id AS string), CASE WHEN doc_id % 3 = 0 THEN '|external attachedTemplate=https://evil.example/t.dotm' ELSE '' END) AS sections FROM documents""")
def extract_ooxml(spark, sf_dir):
    out = G.extract_ooxml(_office(spark, sf_dir))
    lines = F.transform("sections", lambda s: F.concat(s["source"], F.lit("="), s["text"]))
    return out.select("id", "kind", F.md5(F.regexp_replace("body", "[ \n\t\r]", "")).alias("body_digest"), F.array_join(lines, "|").alias("sections"))


@query("active_content", """
SELECT doc_id AS id, concat_ws(',', CASE WHEN doc_id % 4 = 0 THEN 'macro' END, CASE WHEN doc_id % 3 = 0 THEN 'remote_content' END) AS kinds, 'DOC-001' AS rule_id
FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 0""")
def active_content(spark, sf_dir):
    return G.active_content(G.extract_ooxml(_office(spark, sf_dir))).withColumn("kinds", F.array_join("kinds", ","))


@query("classify_files", """
SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'text' ELSE 'unsupported' END AS kind FROM pages""")
def classify_files(spark, sf_dir):
    head = F.expr("CASE page_id % 4 WHEN 0 THEN unhex('255044462D312E37') WHEN 1 THEN unhex('89504E470D0A1A0A') WHEN 2 THEN unhex('') ELSE unhex('C328FF') END")
    files = view(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat(head, F.col("html").cast("binary")).alias("content"))
    return G.classify_files(files.withColumn("length", F.octet_length("content")))


@query("hidden_parts_html", """
SELECT page_id, CASE WHEN starts_with(t, '<!--') THEN 'comment' ELSE 'hidden block' END AS source, t AS text
FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<!--.*?-->|\\[//\\]: # \\(.*?\\)|<span[^>]*display:\\s*none[^>]*>.*?</span>')) AS t FROM pages)""")
def hidden_parts_html(spark, sf_dir):
    return G.hidden_parts_html(view(spark, sf_dir, "pages")).select("page_id", "source", "text")


@query("analysis_text", """
SELECT doc_id AS id, md5(concat(text, chr(10), chr(10), '[note]', chr(10), concat(text, text))) AS digest FROM documents""")
def analysis_text(spark, sf_dir):
    section = F.array(F.struct(F.lit("note").alias("source"), F.concat("text", "text").alias("text")), F.struct(F.lit("empty").alias("source"), F.lit("").alias("text")))
    kept = F.filter(section, lambda s: s["text"] != "")
    return view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(G.analysis_text(F.col("text"), kept)).alias("digest"))


@query("locate_findings", f"""
WITH corpus AS (SELECT doc_id, source, text FROM documents), {_VARIANTS.strip()}, {_JUDGED.strip()}
SELECT doc_id AS id, 'body' AS part, array_to_string(list_sort(list_distinct(list_concat(sigs, list_filter([CASE WHEN sec THEN 'SEC-001' END, CASE WHEN pii THEN 'PII-001' END,
  CASE WHEN inj THEN 'INJ-001' END], lambda x: x IS NOT NULL)))), ',') AS rules FROM judged
UNION ALL SELECT doc_id AS id, 'hidden text (w:vanish)' AS part, '' AS rules FROM documents
UNION ALL SELECT doc_id, 'comment by Ann', CASE WHEN {_holds_pii("note")} THEN 'PII-001,SEC-001' ELSE 'SEC-001' END
  FROM (SELECT doc_id, 'key AKIA' || lpad(cast(doc_id AS string), 16, '0') AS note FROM documents)
UNION ALL SELECT doc_id, 'document properties: subject', '' FROM documents
UNION ALL SELECT doc_id, 'external attachedTemplate', '' FROM documents WHERE doc_id % 3 = 0""")
def locate_findings(spark, sf_dir):
    """Rules that fire in the body and in each hidden part of every document."""
    out = G.locate_findings(G.extract_ooxml(_office(spark, sf_dir)))
    return out.select("id", "part", F.array_join("rules", ",").alias("rules"))
