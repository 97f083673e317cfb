"""Document files: kinds, hidden parts, active content, and where in a document a rule fires."""

from __future__ import annotations

import html
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from callwarden.functions import spans as S
from callwarden.operators import content as C
from callwarden.rules.patterns import HIDDEN_BLOCK, java
from callwarden.sources.files import MAX_DOCUMENT_BYTES

# fixed values: signatures of the first bytes, and properties that carry no text of interest
MAGIC = [("255044462D", "pdf"), ("504B0304", "office"), ("D0CF11E0A1B11AE1", "legacy_office"), ("FFD8FF", "image"),
         ("89504E470D0A1A0A", "image"), ("47494638", "image"), ("49492A00", "image"), ("4D4D002A", "image")]
PLAIN_PROPERTIES = set("""
created modified revision TotalTime Pages Words Characters Lines Paragraphs DocSecurity AppVersion CharactersWithSpaces ScaleCrop
LinksUpToDate SharedDoc HyperlinksChanged Template Application PresentationFormat Slides Notes HiddenSlides MMClips
""".split())
REMOTE_KINDS = {"attachedTemplate", "oleObject", "frame", "subDocument"}
REMOTE_TARGET = r"(?i)(file:|\\\\|https?://\S+\.(exe|dll|ps1|bat|cmd|hta|js|vbs|dotm|docm)$)"
CALLING_FORMULA = (r"(?i)\b(cmd|powershell|mshta|msexcel)\s*\||\bDDE(AUTO)?\b|\bWEBSERVICE\s*\(|\bCALL\s*\(|\bREGISTER(\.ID)?\s*\("
                   r"|\bEXEC\s*\(")


#: Members that leave a worker together: so many, or as many as reach so many characters.
BATCH_ROWS = 1_000
BATCH_CHARS = 4_000_000


def classify_files(files: DataFrame) -> DataFrame:
    """Kind of each file (id, length, content) by its first bytes; UTF-8 is the fallback."""
    head = F.hex(F.substring("content", 1, 8))
    kind = F.when(F.col("length") > MAX_DOCUMENT_BYTES, "too_large")
    for prefix, name in MAGIC:
        kind = kind.when(head.startswith(prefix), name)
    kind = kind.when(head.startswith("52494646") & (F.hex(F.substring("content", 9, 4)) == "57454250"), "image")  # WEBP in a RIFF file
    return files.select("id", kind.when(F.is_valid_utf8(F.col("content").cast("string")), "text").otherwise("unsupported").alias("kind"))


def hidden_parts_html(pages: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    """(key, pos, source, text): comments and hidden blocks of raw markup."""
    found = F.regexp_extract_all(F.col(text), F.lit(java(HIDDEN_BLOCK)), F.lit(0))
    out = pages.select(key, F.posexplode(found).alias("pos", "text"))
    source = F.when(F.col("text").startswith("<!--"), "comment").when(F.col("text").startswith("["), "markdown comment").otherwise("hidden block")
    return out.select(key, "pos", source.alias("source"), "text")


# ---------------------------------------------------------------- Office files: one row per member, then expressions


def _members(content: bytes) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in z.namelist():
                markup = name.endswith((".xml", ".rels"))
                try:
                    yield name, z.read(name).decode("utf-8", "replace") if markup else None, None
                except Exception as exc:  # encrypted, damaged or packed in an unknown way
                    yield name, None, type(exc).__name__
    except Exception as exc:  # no readable directory
        yield None, None, type(exc).__name__


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The members of the files, many in one frame: a frame for each costs more than reading it."""
    rows: list[tuple] = []
    held = 0
    for b in batches:
        for key, content in zip(b["id"], b["content"]):
            for part, xml, error in _members(bytes(content)):
                rows.append((key, part, xml, error))
                held += len(xml or "")
                if len(rows) >= BATCH_ROWS or held >= BATCH_CHARS:
                    yield pd.DataFrame(rows, columns=["id", "part", "xml", "error"])
                    rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=["id", "part", "xml", "error"])


def office_parts(files: DataFrame) -> DataFrame:
    """(id, part, xml, error): one row per member of each ZIP file; only markup is read. What cannot be read is a row with its error."""
    id_type = dict(files.dtypes)["id"]
    zipped = files.where(F.hex(F.substring("content", 1, 4)) == "504B0304").select("id", "content")
    return zipped.mapInPandas(_unzip, f"id {id_type}, part string, xml string, error string")


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def _texts(xml: Column, tag: str) -> Column:
    """Character data of all elements of a tag."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?(?<!/)>([^<]*)</{tag}>"), F.lit(1))


def _section(source: Column | str, text: Column) -> Column:
    return F.array(F.struct((F.lit(source) if isinstance(source, str) else source).alias("source"), text.alias("text")))


def _attribute(element: Column, name: str) -> Column:
    return F.regexp_extract(element, rf'\b{name}="([^"]*)"', 1)


def _hidden_sections() -> list[tuple[str, Column]]:
    """Pattern of a member's name, and the sections it holds, in the order of the report."""
    xml, part = F.col("xml"), F.col("part")
    every = lambda pattern, group=0: F.regexp_extract_all(xml, F.lit(pattern), F.lit(group))
    joined = lambda parts: F.array_join(parts, " ")
    shown_slide = ~xml.rlike(r'<p:sld\b[^>]*\bshow="0"')
    number = F.regexp_extract("part", r"(\d+)\.xml$", 1)
    runs = F.filter(every(r"(?s)<w:r[ >].*?</w:r>"), lambda r: r.rlike(r"<w:vanish(\s[^>]*)?/>"))
    by_author = F.transform(every(r"(?s)<w:comment\b.*?</w:comment>"), lambda c: F.struct(
        F.concat(F.lit("comment by "), _attribute(c, "w:author")).alias("source"), joined(_texts(c, "w:t")).alias("text")))
    named = F.transform(every(r"(?s)<(?:[\w]+:)?\w+(?:\s[^>]*)?>[^<]+</"), lambda e: F.struct(
        F.regexp_extract(e, r"^<(?:\w+:)?(\w+)", 1).alias("name"), F.regexp_extract(e, r"(?s)>([^<]+)</$", 1).alias("text")))
    telling = F.filter(named, lambda p: ~p["name"].isin(*sorted(PLAIN_PROPERTIES)))
    label = F.when(part == "docProps/core.xml", "document properties: ").when(part == "docProps/app.xml", "application properties: ").otherwise("custom property ")
    custom = F.transform(every(r"(?s)<property\b.*?</property>"), lambda p: F.struct(
        F.concat(F.lit("custom property "), _attribute(p, "name")).alias("source"), F.trim(F.regexp_replace(p, "<[^>]*>", " ")).alias("text")))
    links = F.filter(every(r"<Relationship\b[^>]*>"), lambda r: _attribute(r, "TargetMode") == "External")
    hidden_sheets = F.filter(every(r"<sheet\b[^>]*>"), lambda s: _attribute(s, "state").isin("hidden", "veryHidden"))
    names = F.transform(every(r"(?s)<definedName\b.*?</definedName>"), lambda n: F.struct(
        F.concat(F.lit("defined name "), _attribute(n, "name")).alias("source"), F.regexp_replace(n, "<[^>]*>", "").alias("text")))
    return [
        (r"word/document\.xml", _section("hidden text (w:vanish)", joined(F.transform(runs, lambda r: F.array_join(_texts(r, "w:t"), ""))))),
        (r"word/(foot|end)notes\.xml", _section(F.regexp_extract("part", r"(\w+)\.xml$", 1), joined(_texts(xml, "w:t")))),
        (r"word/comments\.xml", by_author),
        (r"xl/workbook\.xml", F.concat(F.transform(hidden_sheets, lambda s: F.struct(F.lit("hidden sheet").alias("source"), _attribute(s, "name").alias("text"))), names)),
        (r"xl/worksheets/.*\.xml", _section("formulas", F.array_join(_texts(xml, "f"), "\n"))),
        (r"xl/(comments|threadedComments/).*\.xml", _section("cell comment", joined(F.concat(_texts(xml, "t"), _texts(xml, "text"))))),
        (r"xl/externalLinks/.*", _section("external workbook links", part)),
        (r"ppt/slides/slide\d+\.xml", _section(F.concat(F.lit("hidden slide "), number), F.when(shown_slide, "").otherwise(F.array_join(_texts(xml, "a:t"), "\n")))),
        (r"ppt/notesSlides/.*\.xml", _section(F.concat(F.lit("speaker notes "), number), F.array_join(_texts(xml, "a:t"), "\n"))),
        (r"ppt/comments/.*\.xml", _section("slide comment", joined(_texts(xml, r"\w+:text")))),
        (r"docProps/(core|app)\.xml", F.transform(telling, lambda p: F.struct(F.concat(label, p["name"]).alias("source"), p["text"].alias("text")))),
        (r"docProps/custom\.xml", custom),
        (r".*\.rels", F.transform(links, lambda r: F.struct(
            F.concat(F.lit("external "), F.regexp_extract(_attribute(r, "Type"), "([^/]*)$", 1)).alias("source"), _attribute(r, "Target").alias("text")))),
    ]


def _body() -> Column:
    """Shown text of a member. Word: runs that vanish are cut, paragraphs are lines. Workbooks: shared and inline strings."""
    xml, part = F.col("xml"), F.col("part")
    runs = F.transform(F.split(xml, "</w:r>"), lambda r: F.when(r.rlike(r"<w:vanish(\s[^>]*)?/>"), F.regexp_replace(r, r"(?s)<w:r[ >].*$", "")).otherwise(r))
    lines = F.transform(F.split(F.array_join(runs, "</w:r>"), "</w:p>"), lambda p: F.array_join(_texts(p, "w:t"), ""))
    slide = F.when(~xml.rlike(r'<p:sld\b[^>]*\bshow="0"'), F.array_join(_texts(xml, "a:t"), "\n"))
    return (F.when(part == "word/document.xml", F.array_join(lines, "\n")).when(part.rlike(r"^xl/(sharedStrings|worksheets/.*)\.xml$"), F.array_join(_texts(xml, "t"), "\n"))
            .when(part.rlike(r"^ppt/slides/slide\d+\.xml$"), slide))


def _active() -> Column:
    xml, part = F.col("xml"), F.col("part")
    found = lambda kind, when, detail: F.when(when, F.struct(F.lit(kind).alias("kind"), detail.alias("detail")))
    formulas = F.transform(F.filter(_texts(xml, "f"), lambda f: f.rlike(CALLING_FORMULA)), lambda f: F.struct(F.lit("dde_formula").alias("kind"), f.alias("detail")))
    links = F.filter(F.regexp_extract_all(xml, F.lit(r"<Relationship\b[^>]*>"), F.lit(0)), lambda r: (_attribute(r, "TargetMode") == "External") & (
        F.regexp_extract(_attribute(r, "Type"), "([^/]*)$", 1).isin(*sorted(REMOTE_KINDS)) | _attribute(r, "Target").rlike("^" + REMOTE_TARGET)))
    remote = F.transform(links, lambda r: F.struct(F.lit("remote_content").alias("kind"), _attribute(r, "Target").alias("detail")))
    none = F.array().cast("array<struct<kind:string,detail:string>>")
    return F.concat(
        F.array_compact(F.array(found("unreadable", F.col("error").isNotNull(), F.concat_ws(": ", "part", "error")),
                                found("macro", part.endswith("vbaProject.bin"), F.lit("vbaProject.bin")),
                                found("embedded_file", part.rlike("^(word|xl|ppt)/embeddings/."), F.regexp_extract("part", "([^/]*)$", 1)))),
        F.coalesce(F.when(part.startswith("xl/worksheets/"), formulas), none), F.coalesce(F.when(part.endswith(".rels"), remote), none))


def extract_ooxml(files: DataFrame) -> DataFrame:
    """(id, kind, body, sections, active) of Office files, whatever their size.

    A file without a main part is ``unsupported``, one without a readable directory ``unreadable``; members that cannot be read are
    active parts of kind ``unreadable``, so a padded or damaged file never passes for a clean one.
    """
    none = F.array().cast("array<struct<source:string,text:string>>")
    rank, held = F.lit(None).cast("int"), none
    for i, (pattern, made) in reversed(list(enumerate(_hidden_sections()))):
        fits = F.col("part").rlike(f"^{pattern}$")
        rank, held = F.when(fits, F.lit(i)).otherwise(rank), F.when(fits, made).otherwise(held)
    number = F.coalesce(F.try_to_number(F.regexp_extract("part", r"(\d+)\.\w+$", 1), F.lit("999999999")).cast("long"), F.lit(0))
    read = S.stage(office_parts(files).withColumn("part", F.coalesce("part", F.lit(""))), place=rank, number=number, held=F.coalesce(held, none), shown=_body(), active=_active())
    main = F.when(F.col("part") == "word/document.xml", "docx").when(F.col("part") == "xl/workbook.xml", "xlsx").when(F.col("part") == "ppt/presentation.xml", "pptx")
    order = lambda col: F.array_sort(F.collect_list(F.struct("place", "number", "part", col)))
    packed = read.groupBy("id").agg(
        F.coalesce(F.min(main), F.when(F.max(F.col("part") == ""), "unreadable"), F.lit("unsupported")).alias("kind"),
        order("shown").alias("shown"), order("held").alias("held"), F.flatten(F.array_sort(F.collect_list("active"))).alias("active"))
    body = F.array_join(F.filter(F.transform("shown", lambda s: s["shown"]), lambda s: s.isNotNull() & s.rlike(r"\S")), "\n\n")
    sections = F.flatten(F.transform("held", lambda h: h["held"]))
    # separators that no markup holds: all texts of a file are unescaped in one call
    flat = F.array_join(F.transform(sections, lambda s: F.concat(s["source"], F.lit("\x01"), s["text"])), "\x02")
    plain = S.stage(packed, ["id", "kind", "active"], body=F.btrim(_unescaped(body), F.lit(" \n\t\r")), flat=_unescaped(flat))
    pieces = F.transform(F.filter(F.split("flat", "\x02"), lambda p: p.contains("\x01")), lambda p: F.struct(
        F.substring_index(p, "\x01", 1).alias("source"), F.btrim(F.substring_index(p, "\x01", -1), F.lit(" \n\t\r")).alias("text")))
    return plain.select("id", "kind", "body", F.filter(pieces, lambda s: s["text"] != "").alias("sections"), "active")


def pdf_scripts(files: DataFrame) -> DataFrame:
    """PDF files that carry a script marker, found in their raw bytes."""
    raw = F.decode("content", "ISO-8859-1")
    return files.where(F.hex(F.substring("content", 1, 5)).eqNullSafe("255044462D") & raw.rlike(r"/(JavaScript|JS)\b")).select(
        "id", F.lit("javascript").alias("kind"), F.lit("script marker in the file").alias("detail"))


def active_content(extracted: DataFrame, *more: DataFrame) -> DataFrame:
    """DOC-001 per file with any active part: the sorted kinds found."""
    rows = extracted.select("id", F.explode("active").alias("a")).select("id", "a.kind")
    for m in more:
        rows = rows.unionByName(m.select("id", "kind"))
    return rows.groupBy("id").agg(F.array_sort(F.collect_set("kind")).alias("kinds")).select("id", "kinds", F.lit("DOC-001").alias("rule_id"))


def analysis_text(body: Column, sections: Column) -> Column:
    """Body followed by every hidden part under its label: what the controls check."""
    parts = F.concat(F.array(F.coalesce(body, F.lit(""))), F.transform(
        sections, lambda s: F.concat(F.lit("["), s["source"], F.lit("]\n"), s["text"])))
    return F.array_join(F.filter(parts, lambda p: p.rlike(r"(?U)\S")), "\n\n")


def locate_findings(documents: DataFrame, controls: C.Controls = C.BALANCED, feed: list[dict] | None = None) -> DataFrame:
    """(id, part, rules): which rules fire in the body and in each hidden part."""
    body = F.struct(F.lit("body").alias("part"), F.col("body").alias("text"))
    hidden = F.transform("sections", lambda s: F.struct(s["source"].alias("part"), s["text"].alias("text")))
    parts = documents.select("id", F.posexplode(F.concat(F.array(body), hidden)).alias("pos", "p")).select("id", "pos", "p.part", "p.text")
    scanned = C.scan(parts, "text", "tool_results", feed=feed, entities=controls.entities, parts=("signatures", "secrets", "pii", "injection"))
    found = S.stage(scanned, ["id", "pos", "part"], findings=C.content_findings(controls, "tool_results"))
    return found.select("id", "pos", "part", F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["rule_id"]))).alias("rules"))


