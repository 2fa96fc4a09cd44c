"""Sources: artifact JSON with strict fields, archives, LaTeX trees, manifests, slide packages."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import latex
from ..operators import documents

ARCHIVE = r"(?i)\.(zip|tar|tar\.gz|tgz)$"
#: Members that \\input may name.
INCLUDABLE = r"\.(tex|tikz|pgf|txt|bbl|sty|cls|def|ltx|inc)$"
GRAPHICS = (".pdf", ".png", ".jpg", ".jpeg", ".svg", ".eps")


class ArtifactError(ValueError):
    """An artifact cannot be read as what it should be."""


def read_artifacts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON files, one document each, read strictly: a field that the schema lacks, a value of another kind at any depth, or text that is not JSON, is an error."""
    raw = spark.read.text(path, wholetext=True)
    wrong = documents.validate(raw, documents.node_of(schema), "value").limit(5).collect()
    if wrong:
        raise ArtifactError("; ".join(f"{r['path']}: {r['problem']}" for r in wrong))
    return raw.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("a")).select("a.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, role, sha256, size_bytes) of the files below a path, from Spark's own file source."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    role = F.when(F.lower("path").endswith(".pdf"), "pdf").when(F.col("path").rlike(ARCHIVE), "latex").otherwise("other")
    return f.select("path", role.alias("role"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def is_safe_member(name: str) -> bool:
    name = name.replace("\\", "/")
    return bool(name) and not name.startswith("/") and not re.match(r"^[A-Za-z]:", name) and ".." not in name.split("/")


def archive_members(archives: DataFrame) -> DataFrame:
    """binaryFile rows -> (path, member, content, problem); an archive with any unsafe or special member yields that problem and no content, one that cannot be read (torn, encrypted) a problem.
    Archives are held whole; `sources.archives` reads large ones a member at a time."""

    def members(name: str, data: bytes):
        if name.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield i.filename, not (i.external_attr >> 16 & 0o170000 == 0o120000), lambda i=i: z.read(i)
        else:
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for i in t:
                    if not i.isdir():
                        yield i.name, i.isreg(), lambda i=i: t.extractfile(i).read()

    def read(frames):
        for f in frames:
            rows = []
            for path, data in zip(f["path"], f["content"], strict=True):
                try:
                    own = []
                    for name, plain, content in members(path, data):
                        if not plain or not is_safe_member(name):
                            own = [(path, name, None, "unsafe member")]
                            break
                        own.append((path, name.replace("\\", "/"), content(), None))
                except (*UNREADABLE, tarfile.TarError) as e:
                    own = [(path, None, None, f"unreadable: {type(e).__name__}")]
                rows += own
            yield pd.DataFrame(rows, columns=["path", "member", "content", "problem"])

    return archives.where(F.col("path").rlike(ARCHIVE)).select("path", "content").mapInPandas(read, "path string, member string, content binary, problem string")


def main_tex(members: DataFrame, by: str = "path") -> DataFrame:
    """The main .tex of each archive: a whole document before any other, then the least deep, then the first by name."""
    t = members.where(F.lower("member").endswith(".tex")).withColumn("text", F.col("content").cast("string"))
    whole = F.col("text").contains("\\documentclass") & F.col("text").contains("\\begin{document}")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(whole.cast("int").desc(), F.size(F.split("member", "/")), "member"))
    return t.withColumn("__n", rank).where("__n = 1").drop("__n")


def expanded(members: DataFrame, by: str = "path") -> DataFrame:
    """(path, main, text, problem): the main file of each archive with its includes in place; no text and a problem where they lead out of the archive or in a circle. An archive is one group: a paper's sources."""
    main = main_tex(members, by).select(by, F.col("member").alias("main"))
    named = F.lower("member").rlike(INCLUDABLE)
    tex = members.where(named).select(by, "member", F.col("content").cast("string").alias("text")).join(main, by)

    def one(p: pd.DataFrame) -> pd.DataFrame:
        m = p["main"].iloc[0]
        try:
            text, problem = latex.expand_includes(dict(zip(p["member"], p["text"], strict=True)), m), None
        except ValueError as e:
            text, problem = None, str(e)
        return pd.DataFrame({by: [p[by].iloc[0]], "main": [m], "text": [text], "problem": [problem]})

    return tex.groupBy(by).applyInPandas(one, f"{by} string, main string, text string, problem string")


def _flat(path):
    """A path without empty parts, `.` and `..`; null if it leaves the root."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    out = F.array(F.lit("")).cast("array<string>")
    kept = F.aggregate(parts, out, lambda have, x: F.when(x != "..", F.concat(have, F.array(x))).when(F.size(have) > 1, F.slice(have, 1, F.size(have) - 1)))
    return F.when(~path.startswith("/"), F.array_join(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), "/"))


def resolve_graphics(refs: DataFrame, members: DataFrame, by: str = "path") -> DataFrame:
    """refs(path, main, ref) -> with `member`, the file a graphic is: beside the main file before the root, extensions in fixed order; null if there is none,
    or if the name leads out of the archive."""
    base = F.regexp_extract("main", r"^(.*/)?[^/]*$", 1)
    names = F.when(F.col("ref").rlike(r"\.[A-Za-z]{2,4}$"), F.array("ref")).otherwise(F.array(*[F.concat("ref", F.lit(x)) for x in GRAPHICS]))
    tried = F.concat(F.transform(names, lambda n: _flat(F.concat(base, n))), F.transform(names, _flat))
    e = refs.withColumn("tried", F.when(~F.col("ref").startswith("/"), tried)).select(*refs.columns, F.posexplode("tried").alias("rank", "member"))
    hit = e.where("member IS NOT NULL").join(members.select(by, "member"), [by, "member"]).groupBy(*refs.columns).agg(F.min_by("member", "rank").alias("member"))
    return refs.join(hit, refs.columns, "left")


def graphic_warnings(resolved: DataFrame, by: str = "path") -> DataFrame:
    """(path, ref, warning): references of resolve_graphics that no file answers."""
    return resolved.where("member IS NULL").select(by, "ref", F.concat(F.lit("graphic not found: "), "ref").alias("warning"))


# Fixed values that results depend on: endings of vector graphics, classes in the order of their use, and media types by ending.
VECTOR = (".pdf", ".svg", ".eps")
ORIGINS = {"latex_vector": 1, "latex_raster": 2, "pdf_embedded": 3}
MEDIA = {".pdf": "application/pdf", ".svg": "image/svg+xml", ".eps": "application/postscript", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".tif": "image/tiff", ".tiff": "image/tiff", ".webp": "image/webp"}


def classified_assets(assets: DataFrame, name: str = "file", embedded: str = "embedded", by: str = "paper_id") -> DataFrame:
    """assets(paper_id, asset_id, file, embedded) with origin, priority (vector graphics first, then raster, then pictures embedded in a PDF), media_type (null if
    the ending is unknown) and rank, the place from 1 by priority and then id. A null name is a raster graphic."""
    ending = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(\.[^./]*)$", 1))
    origin = F.when(F.col(embedded), "pdf_embedded").when(ending.isin(*VECTOR), "latex_vector").otherwise("latex_raster")
    lookup = lambda d, key: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), key)
    out = assets.withColumn("origin", origin).withColumn("priority", lookup(ORIGINS, F.col("origin"))).withColumn("media_type", F.try_element_at(F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv]), ending))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("priority", "asset_id")))


_NS = {"a": "http://schemas.openxmlformats.org/drawingml/2006/main", "p": "http://schemas.openxmlformats.org/presentationml/2006/main"}


#: What a broken package raises.
UNREADABLE = (zipfile.BadZipFile, zlib.error, EOFError, OSError, KeyError, ValueError, TypeError, AttributeError, NotImplementedError, RuntimeError, ElementTree.ParseError)


def slide_packages(packages: DataFrame) -> DataFrame:
    """(path, width, height, problem): the slide size in EMU, 0 where none is given, or why the package or a slide in it cannot be read."""

    def one(data: bytes):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                size = ElementTree.fromstring(z.read("ppt/presentation.xml")).find("./p:sldSz", _NS)
                for n in z.namelist():
                    if re.fullmatch(r"ppt/slides/slide\d+\.xml", n):
                        ElementTree.fromstring(z.read(n))
                return (0, 0, None) if size is None else (int(size.get("cx", "0")), int(size.get("cy", "0")), None)
        except UNREADABLE as e:
            return 0, 0, f"{type(e).__name__}: {e}"

    def read(frames):
        for f in frames:
            yield pd.DataFrame([(p, *one(d)) for p, d in zip(f["path"], f["content"], strict=True)], columns=["path", "width", "height", "problem"])

    return packages.select("path", "content").mapInPandas(read, "path string, width long, height long, problem string")


def slide_boxes(packages: DataFrame) -> DataFrame:
    """Text boxes of slide packages: (path, slide, i, text, x, y, cx, cy, font, auto_fit, has_table); a row with null i for a slide without any.
    A package that cannot be read has no rows; `slide_packages` names it."""

    def boxes(data: bytes):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0]))
            for k, name in enumerate(names, 1):
                root = ElementTree.fromstring(z.read(name))
                table, i = root.find(".//a:tbl", _NS) is not None, 0
                for s in root.iterfind(".//p:sp", _NS):
                    text = "".join(t.text or "" for t in s.iterfind(".//a:t", _NS)).strip()
                    off, ext = s.find(".//a:xfrm/a:off", _NS), s.find(".//a:xfrm/a:ext", _NS)
                    if not text or off is None or ext is None:
                        continue
                    try:
                        x, y, cx, cy = int(off.get("x")), int(off.get("y")), int(ext.get("cx")), int(ext.get("cy"))
                    except (TypeError, ValueError):
                        continue
                    sizes = [int(r.get("sz")) / 100 for r in s.iterfind(".//a:rPr", _NS) if (r.get("sz") or "").isdigit()]
                    yield k, i, text, x, y, cx, cy, min(sizes, default=None), s.find(".//a:normAutofit", _NS) is not None, table
                    i += 1
                if not i:
                    yield k, None, None, None, None, None, None, None, None, table

    def read(frames):
        cols = ["path", "slide", "i", "text", "x", "y", "cx", "cy", "font", "auto_fit", "has_table"]
        for f in frames:
            rows = []
            for p, d in zip(f["path"], f["content"], strict=True):
                try:
                    rows += [(p, *b) for b in boxes(d)]
                except UNREADABLE:
                    continue
            out = pd.DataFrame(rows, columns=cols)
            yield out.astype({c: "Int64" for c in ("slide", "i", "x", "y", "cx", "cy")})

    return packages.select("path", "content").mapInPandas(read, "path string, slide long, i long, text string, x long, y long, cx long, cy long, font double, auto_fit boolean, has_table boolean")


# Fixed values that results depend on: what notes must hold, and how a formula looks as text.
NOTE_MARKERS = ("Purpose:", "Main Message:", "Speaking Script:", "Sources:")
EQUATION = re.compile(r"(?:=.+(?:√|\^|/)|(?:softmax|max|sum)\s*\()", re.IGNORECASE)


def _numbered(names: list[str], pattern: str) -> list[str]:
    """Names that match, in the order of the number in them."""
    found = [(re.fullmatch(pattern, n), n) for n in names]
    return [n for _, n in sorted((int(m[1]), n) for m, n in found if m)]


def package_parts(packages: DataFrame) -> DataFrame:
    """(path, n_slides, n_notes, lacking, n_tables, n_equations, has_svg, problem): what a slide package holds. lacking: "part marker" for each note without one of the
    markers; n_equations: slides with text that looks like a formula. A package that cannot be read has a problem and nulls."""

    def texts(root):
        return " ".join(t.text or "" for t in root.iterfind(".//a:t", _NS))

    def one(data: bytes):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = z.namelist()
                slides, notes = _numbered(names, r"ppt/slides/slide(\d+)\.xml"), _numbered(names, r"ppt/notesSlides/notesSlide(\d+)\.xml")
                lacking = [f"{n} {m}" for n in notes for text in [texts(ElementTree.fromstring(z.read(n)))] for m in NOTE_MARKERS if m not in text]
                tables = equations = 0
                for n in slides:
                    root = ElementTree.fromstring(z.read(n))
                    tables += len(root.findall(".//a:tbl", _NS))
                    equations += EQUATION.search(texts(root)) is not None
                return len(slides), len(notes), lacking, tables, equations, any(n.startswith("ppt/media/") and n.endswith(".svg") for n in names), None
        except UNREADABLE as e:
            return None, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def read(frames):
        cols = ["path", "n_slides", "n_notes", "lacking", "n_tables", "n_equations", "has_svg", "problem"]
        for f in frames:
            out = pd.DataFrame([(p, *one(d)) for p, d in zip(f["path"], f["content"], strict=True)], columns=cols)
            yield out.astype({c: "Int64" for c in ("n_slides", "n_notes", "n_tables", "n_equations")} | {"has_svg": "boolean"})

    return packages.select("path", "content").mapInPandas(read, "path string, n_slides long, n_notes long, lacking array<string>, n_tables long, n_equations long, has_svg boolean, problem string")


def structure_errors(parts: DataFrame, slides: int | None = None, notes: bool = False, table: bool = False, equation: bool = False, svg: bool = False) -> DataFrame:
    """(path, error) of packages: unreadable, another number of slides than expected, notes missing or incomplete, and no native table, formula or SVG where one is required."""
    number = lambda c: F.col(c).cast("string")
    rules = [F.when(F.col("problem").isNotNull(), F.concat(F.lit("invalid package: "), "problem"))]
    if slides is not None:
        rules.append(F.when(F.col("n_slides") != slides, F.concat(F.lit(f"expected {slides} slides, found "), number("n_slides"))))
    if notes:
        rules.append(F.when(F.col("n_notes") != F.col("n_slides"), F.concat(F.lit("expected notes for every slide, found "), number("n_notes"), F.lit(" for "), number("n_slides"), F.lit(" slides"))))
    for wanted, found, what in ((table, F.col("n_tables") > 0, "native table"), (equation, F.col("n_equations") > 0, "equation text"), (svg, F.col("has_svg"), "source SVG")):
        if wanted:
            rules.append(F.when(~found, F.lit(f"no {what} was found")))
    lacking = F.transform(F.coalesce("lacking", F.array().cast("array<string>")), lambda x: F.regexp_replace(x, " (?=[A-Z])", " is missing "))
    return parts.select("path", F.explode(F.concat(F.array_compact(F.array(*rules)), lacking)).alias("error"))


def safe_content_types(content_types: str, members: list[str]) -> tuple[str, int]:
    """[Content_Types].xml without the entries of slide masters that the package does not hold, and how many went."""
    have, gone = set(members), 0

    def keep(m: re.Match) -> str:
        nonlocal gone
        if m[1] in have:
            return m[0]
        gone += 1
        return ""

    return re.sub(r'<Override\b[^>]*PartName="/(ppt/slideMasters/slideMaster\d+\.xml)"[^>]*/>', keep, content_types), gone
