"""Packages, files and tables written as a whole or not at all; archives read a member at a time."""

import io
import os
import tarfile
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from folio.operators import elements as E
from folio.sinks import packages, staged
from folio.sources import archives, files


def found(path):
    return sorted(os.path.relpath(os.path.join(d, n), path) for d, _, names in os.walk(path) for n in names)


def deck(spark):
    slides = spark.createDataFrame(
        [("p/1", "a", 1, "intro", None, "Title <1> & 标题", "claim", ["one", "two"], "take\x0baway", ["c1"], "minimal_text"), ("p/1", "b", 2, "next", "tech", "Second", "claim", ["x"], None, None, "table_focus"), ("q", "a", 1, "s", None, "T", "c", ["y"], "k", [], "process")],
        "paper_id string, slide_id string, number int, section string, technical_title string, title string, main_claim string, body array<string>, takeaway string, citations array<string>, layout string",
    )
    visuals = spark.createDataFrame(
        [("p/1", "b", 0, "source_table", "t1", "cap", "native_table", [], None, None, None, [["h", "i"], ["1"]], None, None)],
        "paper_id string, slide_id string, pos int, kind string, source_ref string, caption string, treatment string, annotations array<string>, column_labels array<string>, image_w long, image_h long, cells array<array<string>>, formula string, formula_number int",
    )
    noted = slides.select("*", *[F.lit("n").alias(f"notes_{c}") for c in ("purpose", "message", "script", "guidance", "transition")], F.lit(5).alias("notes_seconds"))
    return slides, E.slide_elements(slides, visuals), E.note_texts(noted)


def test_packages_round_trip(spark, tmp_path):
    slides, elements, notes = deck(spark)
    to = f"file://{tmp_path}/out"
    packages.write_packages(slides, elements, notes, to)
    assert sorted(n.split("/")[-1] for n in found(tmp_path / "out")) == ["p%2F1.pptx", "q.pptx"]
    back = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(to)
    paper = F.when(F.col("path").endswith("q.pptx"), "q").otherwise("p/1")
    boxes = files.slide_boxes(back).where("i IS NOT NULL").select(paper.alias("paper"), "slide", "text", "x", "y", "cx", "cy", "font")
    emu = lambda c: F.round(F.col(c) * 914400).cast("long")
    number = slides.select("paper_id", "slide_id", "number")
    want = elements.join(number, ["paper_id", "slide_id"]).where("kind <> 'table' AND trim(text) <> ''").select("paper_id", "number", F.translate("text", "\x0b", ""), emu("x"), emu("y"), emu("w"), emu("h"), "font")
    assert {tuple(r) for r in boxes.collect()} == {tuple(r) for r in want.collect()}
    parts = {r["path"].rsplit("/", 1)[1]: r for r in files.package_parts(back).collect()}
    assert [(n, r["n_slides"], r["n_notes"], r["n_tables"], list(r["lacking"]), r["problem"]) for n, r in sorted(parts.items())] == [("p%2F1.pptx", 2, 2, 1, [], None), ("q.pptx", 1, 1, 0, [], None)]
    assert {(r["width"], r["height"], r["problem"]) for r in files.slide_packages(back).collect()} == {(12192000, 6858000, None)}
    assert packages.repaired(back).where("n_removed <> 0 OR problem IS NOT NULL").isEmpty()


def test_every_part_is_declared_and_related():
    out = io.BytesIO()
    assert packages.write_package(out, iter([{"elements": [], "notes": None}] * 3)) == 3
    with zipfile.ZipFile(out) as z:
        names = set(z.namelist())
        types = z.read("[Content_Types].xml").decode()
        for n in names:
            if not n.endswith(".rels") and n != "[Content_Types].xml":
                assert f'PartName="/{n}"' in types, n
            else:
                base = os.path.dirname(os.path.dirname(n))
                for target in __import__("re").findall(r'Target="([^"]+)"', z.read(n).decode()):
                    assert os.path.normpath(os.path.join(base, target)) in names


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    slides, elements, notes = deck(spark)
    packages.write_packages(slides, elements, notes, str(tmp_path))
    before = found(tmp_path)
    broken = slides.withColumn("paper_id", F.when(F.col("paper_id") == "q", F.col("paper_id")))
    with pytest.raises(Exception, match="needs a paper_id"):
        packages.write_packages(broken, elements, notes, str(tmp_path), mode="overwrite")
    assert found(tmp_path) == before and not [n for n in os.listdir(tmp_path) if n.startswith("_staging")]


def test_files_append_and_overwrite(spark, tmp_path):
    rows = lambda *names: spark.createDataFrame([(n, n.encode()) for n in names], "name string, content binary")
    staged.write_files(rows("a b.json", "x/../y"), str(tmp_path / "new"))
    staged.write_files(rows("c"), str(tmp_path / "new"))
    assert sorted(n.split("/")[-1] for n in found(tmp_path / "new")) == ["a b.json", "c", "x%2F..%2Fy"]
    staged.write_files(rows("d"), str(tmp_path / "new"), mode="overwrite")
    assert [n.split("/")[-1] for n in found(tmp_path / "new")] == ["d"]
    with pytest.raises(Exception, match="name"):
        spark.createDataFrame([(1,)], "k int").write.format("binary_files").mode("append").save(str(tmp_path))


def test_what_lost_tasks_left_is_not_committed(tmp_path):
    w = staged.FileWriter(str(tmp_path), overwrite=False)
    good, twice = (w.write(iter([{"name": "f", "content": b"1"}])) for _ in range(2))
    assert twice.files == 1 and good.size == 1
    w.commit([good, None])
    assert len(found(tmp_path)) == 1 and os.listdir(tmp_path)[0].startswith("part-00000-")
    with pytest.raises(TypeError):
        w.write(iter([{"name": "f", "content": b"1"}, {"name": "g", "content": None}]))
    w.abort([])
    assert len(found(tmp_path)) == 1


def test_tables_are_put_in_place_together(spark, tmp_path):
    one, two = spark.range(3), spark.range(5)
    staged.write_tables({"a": one, "b": two}, str(tmp_path))
    fails = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        staged.write_tables({"a": two, "b": fails}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/a").count() == 3 and sorted(os.listdir(tmp_path)) == ["a", "b"]
    staged.write_tables({"a": two}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/a").count() == 5 and sorted(os.listdir(tmp_path)) == ["a", "b"]


def test_delivery(spark):
    f = spark.createDataFrame([(1, "deck.pptx"), (1, "notes.md"), (1, "scratch"), (2, "notes.md")], "run_id int, name string")
    mine, lacking = staged.delivered(f, ("deck.pptx", "notes.md"), "deck.pptx")
    assert mine.count() == 3 and [r["run_id"] for r in lacking.collect()] == [2]


def test_repaired_packages(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", '<Types><Override PartName="/ppt/slideMasters/slideMaster1.xml" ContentType="m"/><Override PartName="/ppt/slideMasters/slideMaster2.xml" ContentType="m"/></Types>')
        z.writestr("ppt/slideMasters/slideMaster1.xml", "<m/>")
    got = {r["path"]: r for r in packages.repaired(spark.createDataFrame([("a", out.getvalue()), ("b", b"PK no")], "path string, content binary")).collect()}
    with zipfile.ZipFile(io.BytesIO(bytes(got["a"]["content"]))) as z:
        assert "slideMaster2" not in z.read("[Content_Types].xml").decode() and z.read("ppt/slideMasters/slideMaster1.xml") == b"<m/>"
    assert (got["a"]["n_removed"], got["b"]["n_removed"]) == (1, 0) and got["b"]["problem"].startswith("BadZipFile") and bytes(got["b"]["content"]) == b"PK no"


def put_zip(path, *entries, **kw):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)


def put_tar(path, *entries, link=False):
    with tarfile.open(path, "w:gz") as t:
        for name, data in entries:
            i = tarfile.TarInfo(name)
            i.size = len(data)
            t.addfile(i, io.BytesIO(data))
        if link:
            i = tarfile.TarInfo("link")
            i.type, i.linkname = tarfile.SYMTYPE, "/etc/passwd"
            t.addfile(i)


def test_archives_and_their_problems(spark, tmp_path):
    put_zip(tmp_path / "good.zip", ("a/b.tex", "text"), ("empty", ""), ("big", b"x" * 5000))
    put_zip(tmp_path / "unsafe.zip", ("ok", "1"), ("../up", "2"))
    (tmp_path / "sub").mkdir()
    put_tar(tmp_path / "sub" / "good.tgz", ("m.tex", b"tar text"), ("n", b"2"))
    put_tar(tmp_path / "link.tar.gz", ("m", b"1"), link=True)
    (tmp_path / "torn.zip").write_bytes(b"PK\x03\x04 torn")
    (tmp_path / "torn.tar.gz").write_bytes((tmp_path / "sub" / "good.tgz").read_bytes()[:40])
    (tmp_path / "other.txt").write_text("no archive")
    data = bytearray((tmp_path / "good.zip").read_bytes())
    at = data.index(b"a/b.tex") + len("a/b.tex")
    data[at : at + 2] = b"\xff\xff"  # breaks the first member's compressed bytes
    (tmp_path / "member.zip").write_bytes(data)
    data = bytearray((tmp_path / "good.zip").read_bytes())
    data[data.index(b"PK\x01\x02") + 8] |= 1  # says that the first member is encrypted
    (tmp_path / "secret.zip").write_bytes(data)
    got = {}
    for r in archives.read_archives(spark, str(tmp_path), most=4096).collect():
        got.setdefault(r["archive"].rsplit("/", 1)[1], {})[r["member"]] = (r["size"], None if r["content"] is None else bytes(r["content"]), r["problem"])
    good = {"a/b.tex": (4, b"text", None), "empty": (0, b"", None), "big": (5000, None, "larger than 4096 bytes")}
    assert got["good.zip"] == good and got["good.tgz"] == {"m.tex": (8, b"tar text", None), "n": (1, b"2", None)}
    assert got["unsafe.zip"] == {"../up": (None, None, "unsafe member")} and got["link.tar.gz"] == {"link": (None, None, "unsafe member")}
    assert list(got["torn.zip"]) == [None] and got["torn.zip"][None][2].startswith("unreadable") and list(got["torn.tar.gz"].values())[-1][2].startswith("unreadable")
    assert got["secret.zip"] == good | {"a/b.tex": (None, None, "encrypted")}
    assert got["member.zip"]["a/b.tex"][2].startswith("unreadable") and got["member.zip"]["empty"] == good["empty"]
    assert "other.txt" not in got and len(got) == 8


def test_a_large_member_is_read_in_pieces(tmp_path):
    with zipfile.ZipFile(tmp_path / "large.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("zeros", "w") as f:
        for _ in range(300):
            f.write(bytes(1 << 20))
    tracemalloc.start()
    rows = list(archives.members(str(tmp_path / "large.zip"), most=8 << 20))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows[0][2] == 300 << 20 and rows[0][5].startswith("larger") and peak < 24 << 20


def test_archives_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put_zip(tmp_path / "in" / "a.zip", ("x", "1"), ("y", "2"))

    def run():
        q = archives.stream_archives(spark, str(tmp_path / "in")).select("archive", "member").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        return sorted(r["member"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["x", "y"]
    os.utime(tmp_path / "in" / "a.zip", (1, 1))
    put_zip(tmp_path / "in" / "b.zip", ("z", "3"))
    assert run() == ["x", "y", "z"] == run()


def test_many_small_archives_share_tasks(spark, tmp_path):
    for k in range(2500):
        with zipfile.ZipFile(tmp_path / f"a{k}.zip", "w") as z:
            z.writestr("m.txt", str(k))
    read = archives.read_archives(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() == 3 and read.select("archive").distinct().count() == 2500
