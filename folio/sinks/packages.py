"""Slide packages (.pptx): one a paper, with native text, tables and notes, written by tasks and committed as a whole."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from itertools import groupby
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from ..functions.geometry import EMU_PER_INCH
from ..sources.files import UNREADABLE, safe_content_types
from .staged import StagedWriter

#: Slide size in EMU: 13.333 x 7.5 inches.
WIDTH, HEIGHT = 12192000, 6858000
_A, _P, _R = ("http://schemas.openxmlformats.org/" + x for x in ("drawingml/2006/main", "presentationml/2006/main", "officeDocument/2006/relationships"))
_NS = f'xmlns:a="{_A}" xmlns:p="{_P}" xmlns:r="{_R}"'
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: What XML cannot hold.
_BARRED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")
SHAPES = {"step_arrow": "homePlate", "rule": "line", "mark": "line", "annotation_mark": "line"}


def _words(text: str) -> str:
    return escape(_BARRED.sub("", text))


def _body(text: str, font: float | None) -> str:
    size = f' sz="{round(font * 100)}"' if font else ""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return "<a:bodyPr/><a:lstStyle/>" + "".join(f'<a:p><a:r><a:rPr lang="zh-CN"{size}/><a:t>{_words(x)}</a:t></a:r></a:p>' for x in lines)


def _box(e) -> str:
    x, y, w, h = (round((e[c] or 0.0) * EMU_PER_INCH) for c in "xywh")
    return f'<a:off x="{x}" y="{y}"/><a:ext cx="{max(0, w)}" cy="{max(0, h)}"/>'


def shape(e, number: int) -> str:
    """An element as a shape, or as a native table."""
    named = f'<p:cNvPr id="{number}" name="{escape(e["kind"])} {number}"/>'
    if e["cells"]:
        wide = max(map(len, e["cells"]))
        w, h = round((e["w"] or 0) * EMU_PER_INCH), round((e["h"] or 0) * EMU_PER_INCH)
        cell = lambda t: f"<a:tc><a:txBody>{_body(t or '', e['font'])}</a:txBody><a:tcPr/></a:tc>"
        rows = "".join(f'<a:tr h="{h // len(e["cells"])}">{"".join(map(cell, [*r, *[""] * (wide - len(r))]))}</a:tr>' for r in e["cells"])
        grid = "".join(f'<a:gridCol w="{w // max(1, wide)}"/>' for _ in range(wide))
        return f'<p:graphicFrame><p:nvGraphicFramePr>{named}<p:cNvGraphicFramePr/><p:nvPr/></p:nvGraphicFramePr><p:xfrm>{_box(e)}</p:xfrm><a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/table"><a:tbl><a:tblPr firstRow="1"/><a:tblGrid>{grid}</a:tblGrid>{rows}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    text = f"<p:txBody>{_body(e['text'], e['font'])}</p:txBody>" if e["text"] else ""
    return f'<p:sp><p:nvSpPr>{named}<p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm>{_box(e)}</a:xfrm><a:prstGeom prst="{SHAPES.get(e["kind"], "rect")}"><a:avLst/></a:prstGeom></p:spPr>{text}</p:sp>'


_TREE = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'


def _page(tag: str, shapes: str, tail: str = "") -> str:
    return f"{_HEAD}<p:{tag} {_NS}><p:cSld><p:spTree>{_TREE}{shapes}</p:spTree></p:cSld>{tail}</p:{tag}>"


def _relations(*targets: tuple[str, str]) -> str:
    rows = "".join(f'<Relationship Id="rId{k}" Type="{_R}/{kind}" Target="{to}"/>' for k, (kind, to) in enumerate(targets, 1))
    return f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rows}</Relationships>'


_MAP = '<p:clrMap bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" accent1="accent1" accent2="accent2" accent3="accent3" accent4="accent4" accent5="accent5" accent6="accent6" hlink="hlink" folHlink="folHlink"/>'


def _theme() -> str:
    colours = "".join(f'<a:{n}><a:srgbClr val="{v}"/></a:{n}>' for n, v in zip(("dk1", "lt1", "dk2", "lt2", *(f"accent{k}" for k in range(1, 7)), "hlink", "folHlink"), ("000000", "FFFFFF", *["44546A"] * 10), strict=True))
    fonts = "".join(f'<a:{n}Font><a:latin typeface="Arial"/><a:ea typeface=""/><a:cs typeface=""/></a:{n}Font>' for n in ("major", "minor"))
    fill, line = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>', '<a:ln><a:solidFill><a:schemeClr val="phClr"/></a:solidFill></a:ln>'
    styles = f"<a:fillStyleLst>{fill * 3}</a:fillStyleLst><a:lnStyleLst>{line * 3}</a:lnStyleLst><a:effectStyleLst>{'<a:effectStyle><a:effectLst/></a:effectStyle>' * 3}</a:effectStyleLst><a:bgFillStyleLst>{fill * 3}</a:bgFillStyleLst>"
    return f'{_HEAD}<a:theme xmlns:a="{_A}" name="plain"><a:themeElements><a:clrScheme name="plain">{colours}</a:clrScheme><a:fontScheme name="plain">{fonts}</a:fontScheme><a:fmtScheme name="plain">{styles}</a:fmtScheme></a:themeElements></a:theme>'


def _notes(text: str, number: int) -> str:
    picture = '<p:sp><p:nvSpPr><p:cNvPr id="2" name="slide"/><p:cNvSpPr/><p:nvPr><p:ph type="sldImg"/></p:nvPr></p:nvSpPr><p:spPr/></p:sp>'
    words = f'<p:sp><p:nvSpPr><p:cNvPr id="3" name="notes"/><p:cNvSpPr/><p:nvPr><p:ph type="body" idx="1"/></p:nvPr></p:nvSpPr><p:spPr/><p:txBody>{_body(text, None)}</p:txBody></p:sp>'
    return _page("notes", picture + words)


def write_package(out, slides: Iterator) -> int:
    """A package on a stream from one row a slide, in their order: (elements, notes). Slides are written as they come; only the list of parts is kept. Returns their number."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        n = 0
        for n, r in enumerate(slides, 1):
            z.writestr(f"ppt/slides/slide{n}.xml", _page("sld", "".join(shape(e, k) for k, e in enumerate(r["elements"] or (), 2))))
            z.writestr(f"ppt/slides/_rels/slide{n}.xml.rels", _relations(("slideLayout", "../slideLayouts/slideLayout1.xml"), ("notesSlide", f"../notesSlides/notesSlide{n}.xml")))
            z.writestr(f"ppt/notesSlides/notesSlide{n}.xml", _notes(r["notes"] or "", n))
            z.writestr(f"ppt/notesSlides/_rels/notesSlide{n}.xml.rels", _relations(("notesMaster", "../notesMasters/notesMaster1.xml"), ("slide", f"../slides/slide{n}.xml")))
        kinds = {"ppt/presentation.xml": "presentation.main", "ppt/slideMasters/slideMaster1.xml": "slideMaster", "ppt/slideLayouts/slideLayout1.xml": "slideLayout", "ppt/notesMasters/notesMaster1.xml": "notesMaster"}
        kinds |= {f"ppt/slides/slide{k}.xml": "slide" for k in range(1, n + 1)} | {f"ppt/notesSlides/notesSlide{k}.xml": "notesSlide" for k in range(1, n + 1)}
        types = "".join(f'<Override PartName="/{p}" ContentType="application/vnd.openxmlformats-officedocument.presentationml.{k}+xml"/>' for p, k in kinds.items())
        types += "".join(f'<Override PartName="/ppt/theme/theme{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.theme+xml"/>' for k in (1, 2))
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>')
        z.writestr("_rels/.rels", _relations(("officeDocument", "ppt/presentation.xml")))
        z.writestr("ppt/_rels/presentation.xml.rels", _relations(("slideMaster", "slideMasters/slideMaster1.xml"), ("notesMaster", "notesMasters/notesMaster1.xml"), ("theme", "theme/theme1.xml"), *(("slide", f"slides/slide{k}.xml") for k in range(1, n + 1))))
        ids = "".join(f'<p:sldId id="{255 + k}" r:id="rId{3 + k}"/>' for k in range(1, n + 1))
        lists = f'<p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId1"/></p:sldMasterIdLst><p:notesMasterIdLst><p:notesMasterId r:id="rId2"/></p:notesMasterIdLst>' + (f"<p:sldIdLst>{ids}</p:sldIdLst>" if n else "")
        z.writestr("ppt/presentation.xml", f'{_HEAD}<p:presentation {_NS}>{lists}<p:sldSz cx="{WIDTH}" cy="{HEIGHT}"/><p:notesSz cx="{HEIGHT}" cy="9144000"/></p:presentation>')
        z.writestr("ppt/slideMasters/slideMaster1.xml", _page("sldMaster", "", f'{_MAP}<p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="rId1"/></p:sldLayoutIdLst>'))
        z.writestr("ppt/slideMasters/_rels/slideMaster1.xml.rels", _relations(("slideLayout", "../slideLayouts/slideLayout1.xml"), ("theme", "../theme/theme1.xml")))
        z.writestr("ppt/slideLayouts/slideLayout1.xml", _page("sldLayout", ""))
        z.writestr("ppt/slideLayouts/_rels/slideLayout1.xml.rels", _relations(("slideMaster", "../slideMasters/slideMaster1.xml")))
        z.writestr("ppt/notesMasters/notesMaster1.xml", _page("notesMaster", "", _MAP))
        z.writestr("ppt/notesMasters/_rels/notesMaster1.xml.rels", _relations(("theme", "../theme/theme2.xml")))
        for k in (1, 2):
            z.writestr(f"ppt/theme/theme{k}.xml", _theme())
    return n


class PackageWriter(StagedWriter):
    """Rows of (paper_id, number, elements, notes), a paper's rows together and in order: a package each."""

    def files(self, rows):
        for paper, own in groupby(rows, key=lambda r: r["paper_id"]):
            if paper is None:
                raise ValueError("a package needs a paper_id")
            yield f"{paper}.pptx", lambda out, own=own: write_package(out, own)


class SlidePackages(DataSource):
    """df.write.format("slide_packages").save(path); see write_packages."""

    @classmethod
    def name(cls) -> str:
        return "slide_packages"

    def writer(self, schema, overwrite: bool) -> PackageWriter:
        if not {"paper_id", "number", "elements", "notes"} <= set(schema.fieldNames()):
            raise ValueError("slide_packages takes rows of (paper_id, number, elements, notes)")
        return PackageWriter(self.options["path"], overwrite)


def slide_rows(slides: DataFrame, elements: DataFrame, notes: DataFrame) -> DataFrame:
    """(paper_id, number, elements, notes): one row a slide. slides(paper_id, slide_id, number), elements and notes as `operators.elements` gives them. Slides without elements or notes are blank there."""
    keys = ["paper_id", "slide_id"]
    drawn = elements.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("z", "kind", "text", "cells", "x", "y", "w", "h", "font"))).alias("elements"))
    return slides.select(*keys, "number").join(drawn, keys, "left").join(notes.select(*keys, "notes"), keys, "left").select(F.col("paper_id").cast("string").alias("paper_id"), "number", "elements", "notes")


def write_packages(slides: DataFrame, elements: DataFrame, notes: DataFrame, path: str, mode: str = "append") -> None:
    """<path>/part-*/<paper_id>.pptx for every paper, all or none.

    A paper's slides meet in one task, sorted by number, and are written as they come: a task holds one slide at a time. Elements are gathered by slide, so no row is larger than a slide.
    """
    slides.sparkSession.dataSource.register(SlidePackages)
    rows = slide_rows(slides, elements, notes)
    rows.repartition("paper_id").sortWithinPartitions("paper_id", "number").write.format("slide_packages").mode(mode).save(path)


def repaired(packages: DataFrame) -> DataFrame:
    """(path, content, n_removed, problem) of binaryFile rows: packages whose list of content types names slide masters that they do not hold are written anew without them, part by part; others stay as they are.
    What cannot be read keeps its content and has a problem."""
    import io

    import pandas as pd

    def one(data: bytes):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                types, gone = safe_content_types(z.read("[Content_Types].xml").decode(), z.namelist())
                if not gone:
                    return data, 0, None
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
                    for i in z.infolist():
                        new.writestr(i, types if i.filename == "[Content_Types].xml" else z.read(i))
                return out.getvalue(), gone, None
        except UNREADABLE as e:
            return data, 0, f"{type(e).__name__}: {e}"

    def read(frames):
        for f in frames:
            yield pd.DataFrame([(p, *one(d)) for p, d in zip(f["path"], f["content"], strict=True)], columns=["path", "content", "n_removed", "problem"])

    return packages.select("path", "content").mapInPandas(read, "path string, content binary, n_removed int, problem string")
