"""Office members as rows, pickle imports by bytes, and the breaker's exemption of synthetic tasks."""

import io
import pickle
import zipfile

from pyspark.sql import functions as F

from callwarden.operators import documents, ledger, supply


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_office_files_of_any_size_and_state(spark):
    big = "x" * (6 * 1024 * 1024)
    word = _zip({"word/document.xml": f"<w:document><w:p><w:r><w:t>a &amp; b</w:t></w:r><w:r><w:rPr><w:vanish/></w:rPr><w:t>unseen</w:t></w:r></w:p></w:document>",
                 "word/footnotes.xml": f"<w:t>{big} tail</w:t>", "word/vbaProject.bin": b"x"})
    sheet = _zip({"xl/workbook.xml": '<sheet name="S2" state="hidden" r:id="r2"/><definedName name="N">A1</definedName>',
                  "xl/sharedStrings.xml": "<si><t>shared</t></si>", "xl/worksheets/sheet1.xml": '<c><f>WEBSERVICE("u")</f><v>1</v></c>'})
    slides = _zip({"ppt/presentation.xml": "<p/>", "ppt/slides/slide2.xml": '<p:sld show="0"><a:t>gone</a:t></p:sld>', "ppt/slides/slide10.xml": "<p:sld><a:t>ten</a:t></p:sld>",
                   "ppt/slides/slide9.xml": "<p:sld><a:t>nine</a:t></p:sld>"})
    broken = bytearray(_zip({"word/document.xml": "<w:t>" + "abc" * 500 + "</w:t>"}))
    broken[45:60] = b"\xff" * 15
    files = [("big", word), ("sheet", sheet), ("slides", slides), ("broken", bytes(broken)), ("cut", b"PK\x03\x04zzz"), ("other", _zip({"a.xml": "<a/>"})), ("text", b"plain"), ("empty", b"")]
    out = documents.extract_ooxml(spark.createDataFrame(files, "id string, content binary"))
    got = {r["id"]: r for r in out.collect()}
    assert set(got) == {"big", "sheet", "slides", "broken", "cut", "other"}
    big_sections = {s["source"]: s["text"] for s in got["big"]["sections"]}
    assert got["big"]["body"] == "a & b" and big_sections["hidden text (w:vanish)"] == "unseen" and big_sections["footnotes"].endswith(" tail")
    assert [a["kind"] for a in got["big"]["active"]] == ["macro"]
    assert {s["source"]: s["text"] for s in got["sheet"]["sections"]} == {"hidden sheet": "S2", "defined name N": "A1", "formulas": 'WEBSERVICE("u")'}
    assert got["sheet"]["body"] == "shared" and [a["kind"] for a in got["sheet"]["active"]] == ["dde_formula"]
    assert got["slides"]["body"] == "nine\n\nten" and [tuple(s) for s in got["slides"]["sections"]] == [("hidden slide 2", "gone")]
    assert got["cut"]["kind"] == "unreadable" and got["other"]["kind"] == "unsupported"
    assert [a["kind"] for a in got["broken"]["active"]] == ["unreadable"] and [a["kind"] for a in got["cut"]["active"]] == ["unreadable"]


def test_pickle_imports_by_bytes(spark):
    import collections

    files = [(i, f"{i}.pkl", data) for i, data in enumerate([
        *[pickle.dumps(collections.OrderedDict, protocol=p) for p in range(6)], pickle.dumps([1, "os.system"]), b"\x80\x02cos\nsystem\n", b""])]
    got = {r["id"]: r["imports"] for r in supply.pickle_imports(spark.createDataFrame(files, "id int, name string, content binary")).collect()}
    assert all(got[i] == ["collections.OrderedDict"] for i in range(6))
    assert got[6] == [] and got[7] == ["os.system", supply.MALFORMED] and got[8] == [supply.MALFORMED]


def test_pickle_imports_cannot_be_hidden(spark):
    import collections
    import pickletools
    import random

    def text(s):
        return b"\x8c" + bytes([len(s)]) + s.encode()

    def old(s):
        return b"U" + bytes([len(s)]) + s.encode()

    hidden = [
        b"\x80\x04" + text("os") + b"N0" + text("system") + b"\x93.",  # something pushed and popped between the names
        b"\x80\x04" + old("os") + old("system") + b"\x93.",
        b"\x80\x04" + text("os") + b"\x94" + text("system") + b"\x940" + b"0" + text("a") + b"0" + text("b") + b"0" + b"h\x00h\x01\x93.",  # names from the memo
        b"\x80\x04(" + text("x") + b"l0" + text("os") + text("system") + b"\x93.",
        b"\x80\x04N." + b"\x80\x04" + text("os") + text("system") + b"\x93.",  # a second stream
        b"(" + b"ios\nsystem\n.",
    ]
    harmless = [b"\x80\x04" + text("cos\nsystem\n") + b".", pickle.dumps({"os": "system"}), pickle.dumps(["os", "system", 2.5, b"cos\nsystem\n"])]
    files = [(i, f"{i}.bin", data) for i, data in enumerate(hidden + harmless)]
    got = {r["id"]: r["imports"] for r in supply.pickle_imports(spark.createDataFrame(files, "id long, name string, content binary")).collect()}
    assert all("os.system" in got[i] and supply.MALFORMED not in got[i] for i in range(len(hidden))), got
    assert all(got[len(hidden) + i] == [] for i in range(len(harmless))), got
    rng = random.Random(2)
    kinds = [collections.OrderedDict, collections.Counter, len, complex(1, 2), {"a": {1, 2}}, [b"x", "y"], (1, None)]
    for protocol in range(6):
        value = [rng.choice(kinds) for _ in range(30)]
        data = pickle.dumps(value, protocol=protocol)
        want = {f"{'__builtin__' if protocol < 3 and m == 'builtins' else m}.{n}" for m, n in
                ((getattr(v, "__module__", "builtins") or "builtins", getattr(v, "__name__", "")) for v in value if v in kinds[:3])}
        assert want <= set(supply.imports_of(data)) and supply.MALFORMED not in supply.imports_of(data)
        cut = supply.imports_of(data[:-1])
        assert cut[-1] == supply.MALFORMED and len(list(pickletools.genops(data))) > 1


def test_breaker_leaves_synthetic_tasks_alone(spark):
    calls = spark.range(20).select("id", F.expr("timestamp_seconds(1700000000 + id)").alias("ts"), F.concat(F.lit("t"), (F.col("id") % 2).cast("string")).alias("task_id"),
                                   F.lit("BLOCK").alias("action"), F.lit(True).alias("blocked"), (F.col("id") % 2 == 0).alias("synthetic"))
    for out, flag in ((ledger.circuit_breaker(calls, 3, 600), "breaker_refused"), (ledger.breaker_feedback(calls, 3, 600), "refused")):
        assert {r["id"] for r in out.where(flag).collect()} == set(range(7, 20, 2))


def test_members_leave_in_few_frames():
    import pandas as pd

    content = _zip({"word/document.xml": "<w:t>a</w:t>", "docProps/core.xml": "<a/>", "word/vbaProject.bin": b"x"})
    frames = list(documents._unzip(iter([pd.DataFrame({"id": range(i, i + 100), "content": [content] * 100}) for i in range(0, 500, 100)])))
    assert [len(f) for f in frames] == [1000, 500]
    large = _zip({"word/document.xml": "x" * 3_000_000, "word/footnotes.xml": "y" * 3_000_000})
    frames = list(documents._unzip(iter([pd.DataFrame({"id": [1, 2], "content": [large, large]})])))
    assert [len(f) for f in frames] == [2, 2] and frames[1]["xml"].str.len().tolist() == [3_000_000] * 2
