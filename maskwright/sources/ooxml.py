"""DOCX and PPTX packages with the standard library: text, alt texts, images, rewriting and scrubbing."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from xml.etree import ElementTree as ET

from ..functions.masking import mask, ranges, segments

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
DC = "{http://purl.org/dc/elements/1.1/}"
CP = "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}"


def local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


class Package:
    """The parts of an OOXML file; XML parts are parsed on demand and written back with their own prefixes."""

    def __init__(self, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            self.items = z.infolist()
            self.parts = {i.filename: z.read(i.filename) for i in self.items}
        self.trees: dict[str, ET.Element] = {}
        self.kind = "docx" if "word/document.xml" in self.parts else "pptx"

    def tree(self, name: str) -> ET.Element:
        if name not in self.trees:
            self.trees[name] = ET.fromstring(self.parts[name])
        return self.trees[name]

    def rels(self, name: str) -> dict[str, tuple[str, str]]:
        """Relations of a part: id to (type's last word, target part)."""
        folder, base = posixpath.split(name)
        path = f"{folder}/_rels/{base}.rels"
        if path not in self.parts:
            return {}
        out = {}
        for r in self.tree(path):
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
                out[r.get("Id")] = (r.get("Type", "").rpartition("/")[2], target)
        return out

    def listed(self, name: str, list_tag: str) -> list[str]:
        """Targets of a part's ordered id list (slides, masters, layouts)."""
        rels = self.rels(name)
        ids = [e.get(f"{R}id") for group in self.tree(name).iter(list_tag) for e in group]
        return [rels[i][1] for i in ids if i in rels and rels[i][1] in self.parts]

    def _bytes(self, name: str) -> bytes:
        raw = self.parts[name]
        spaces = dict(ns for _, ns in ET.iterparse(io.BytesIO(raw), events=["start-ns"]))
        for prefix, uri in spaces.items():
            if not re.fullmatch(r"ns\d+", prefix):
                ET.register_namespace(prefix, uri)
        out = ET.tostring(self.trees[name], encoding="unicode")
        head = out[: out.index(">") + 1]
        missing = "".join(f' xmlns:{p}="{u}"' for p, u in spaces.items() if p and f"xmlns:{p}=" not in head)
        at = re.match(r"<[^\s/>]+", out).end()
        return ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + out[:at] + missing + out[at:]).encode("utf-8")

    def save(self, touched: set[str]) -> bytes:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for item in self.items:
                z.writestr(item, self._bytes(item.filename) if item.filename in touched else self.parts[item.filename])
        return buffer.getvalue()


def _word_text(p) -> str:
    """A Word paragraph's text: runs and hyperlinks, tabs and breaks."""
    out = []
    for child in p:
        for run in [child] if child.tag == f"{W}r" else child.findall(f"{W}r") if child.tag == f"{W}hyperlink" else []:
            out.append(_run_text(run))
    return "".join(out)


def _run_text(run) -> str:
    marks = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}
    return "".join((e.text or "") if local(e.tag) == "t" else marks.get(local(e.tag), "") for e in run)


def _draw_text(p) -> str:
    return "".join("\v" if local(e.tag) == "br" else "".join(t.text or "" for t in e.findall(f"{A}t")) for e in p if local(e.tag) in ("r", "br", "fld"))


def _shapes(tree, deep: bool = True):
    """Shapes under a shape tree in order; groups are entered."""
    for e in tree:
        if local(e.tag) == "grpSp":
            if deep:
                yield from _shapes(e)
        elif local(e.tag) in ("sp", "pic", "graphicFrame", "cxnSp"):
            yield e


def _shape_paragraphs(shape):
    """(None, paragraphs) of a text frame; ((row, column), paragraphs) of each cell of a table."""
    body = shape.find(f"{P}txBody")
    if body is not None:
        yield None, body.findall(f"{A}p")
    for table in shape.iter(f"{A}tbl"):
        for r, row in enumerate(table.findall(f"{A}tr")):
            for c, cell in enumerate(row.findall(f"{A}tc")):
                yield (r + 1, c + 1), [p for b in cell.findall(f"{A}txBody") for p in b.findall(f"{A}p")]


def _name_of(shape) -> str:
    return next((e.get("name") for e in shape.iter() if local(e.tag) == "cNvPr"), None) or "Forme"


def _word_bodies(pkg: Package):
    """(part, body element, header label or None) of the document and of each section's headers and footers."""
    name = "word/document.xml"
    root = pkg.tree(name)
    yield name, root.find(f"{W}body"), None
    rels = pkg.rels(name)
    for sect in root.iter(f"{W}sectPr"):
        for tag, title in (("headerReference", "En-tête"), ("footerReference", "Pied de page")):
            for ref in sect.findall(f"{W}{tag}"):
                target = rels.get(ref.get(f"{R}id"), ("", ""))[1]
                if target in pkg.parts and ref.get(f"{W}type", "default") == "default":
                    yield target, pkg.tree(target), title


def _word_cells(body):
    for t, table in enumerate(body.findall(f"{W}tbl")):
        for r, row in enumerate(table.findall(f"{W}tr")):
            for c, cell in enumerate(row.findall(f"{W}tc")):
                yield t + 1, r + 1, c + 1, cell.findall(f"{W}p")


def _slides(pkg: Package):
    yield from enumerate(pkg.listed("ppt/presentation.xml", f"{P}sldIdLst"), 1)


def _notes(pkg: Package, slide: str):
    """(part, paragraphs) of the notes text of a slide."""
    for kind, target in pkg.rels(slide).values():
        if kind == "notesSlide" and target in pkg.parts:
            for shape in _shapes(pkg.tree(target).find(f"{P}cSld/{P}spTree")):
                ph = next(shape.iter(f"{P}ph"), None)
                if ph is not None and ph.get("type") == "body":
                    yield target, [p for b in shape.findall(f"{P}txBody") for p in b.findall(f"{A}p")]


def text_blocks(pkg: Package) -> list[tuple[str, str]]:
    """(section, text) of every block with text, in document order."""
    out: list[tuple[str, str]] = []

    def add(section: str, text: str) -> None:
        if text.strip():
            out.append((section, text.strip()))

    if pkg.kind == "docx":
        for _, body, title in _word_bodies(pkg):
            for n, p in enumerate(body.findall(f"{W}p"), 1):
                add(title or f"Paragraphe {n}", _word_text(p))
            if title is None:
                for t, r, c, paragraphs in _word_cells(body):
                    add(f"Tableau {t} — Cellule ({r},{c})", "\n".join(x for p in paragraphs if (x := _word_text(p).strip())))
        return out
    for n, slide in _slides(pkg):
        for shape in _shapes(pkg.tree(slide).find(f"{P}cSld/{P}spTree")):
            for cell, paragraphs in _shape_paragraphs(shape):
                texts = [x for p in paragraphs if (x := _draw_text(p).strip())]
                if cell:
                    add(f"Slide {n} — Tableau, Cellule ({cell[0]},{cell[1]})", "\n".join(texts))
                else:
                    for x in texts:
                        add(f"Slide {n} — {_name_of(shape)}", x)
        for _, paragraphs in _notes(pkg, slide):
            for p in paragraphs:
                add(f"Slide {n} — Notes", _draw_text(p))
    return out


def _layers(pkg: Package):
    """(part, layer, label) of slides, then each master with its layouts."""
    for n, slide in _slides(pkg):
        yield slide, "slide", f"Slide {n}"
    for n, master in enumerate(pkg.listed("ppt/presentation.xml", f"{P}sldMasterIdLst"), 1):
        yield master, "master", f"Master {n}"
        for k, layout in enumerate(pkg.listed(master, f"{P}sldLayoutIdLst"), 1):
            name = pkg.tree(layout).find(f"{P}cSld").get("name")
            yield layout, "layout", f"Layout {name or k}"


def _alt_elements(pkg: Package):
    """(part, element, label) of every element whose descr attribute may hold an alt text."""
    if pkg.kind == "docx":
        for part, body, title in _word_bodies(pkg):
            groups = [(title or "Corps du document", body.findall(f"{W}p"))]
            if title is None:
                groups += [(f"Tableau {t}", paragraphs) for t, _, _, paragraphs in _word_cells(body)]
            for where, paragraphs in groups:
                for p in paragraphs:
                    yield from ((part, e, where) for e in p.iter() if local(e.tag) == "docPr")
        return
    for part, _, where in _layers(pkg):
        for shape in _shapes(pkg.tree(part).find(f"{P}cSld/{P}spTree")):
            first = next((e for e in shape.iter() if local(e.tag) == "cNvPr"), None)
            if first is not None:
                yield part, first, where


def alt_texts(pkg: Package) -> list[tuple[str, str]]:
    return [(d, where) for _, e, where in _alt_elements(pkg) if (d := (e.get("descr") or "").strip())]


def images(pkg: Package) -> list[tuple[str, str, str]]:
    """(location, layer, part) of each embedded picture that shapes and drawings show."""
    out = []
    if pkg.kind == "docx":
        for part, body, title in _word_bodies(pkg):
            rels = pkg.rels(part)
            for blip in body.iter(f"{A}blip"):
                target = rels.get(blip.get(f"{R}embed"), ("", ""))[1]
                if target in pkg.parts:
                    out.append((title or "Corps du document", "docx_inline", target))
        return out
    order = {"master": 0, "layout": 1, "slide": 2}
    for part, layer, where in sorted(_layers(pkg), key=lambda x: order[x[1]]):
        rels = pkg.rels(part)
        for shape in _shapes(pkg.tree(part).find(f"{P}cSld/{P}spTree")):
            if local(shape.tag) == "pic":
                for blip in shape.iter(f"{A}blip"):
                    target = rels.get(blip.get(f"{R}embed"), ("", ""))[1]
                    if target in pkg.parts:
                        out.append((where, layer, target))
    return out


def _set_text(t, text: str) -> None:
    t.text = text
    if text != text.strip():
        t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def _copy(e):
    return ET.fromstring(ET.tostring(e))


def _rewrite_word(p, pairs) -> bool:
    runs = p.findall(f"{W}r")
    texts = [_run_text(r) for r in runs]
    full = "".join(texts)
    found = ranges(full, pairs) if full.strip() else []
    if not found:
        return False
    at = list(p).index(runs[0])
    for r in runs:
        p.remove(r)
    for k, (text, source) in enumerate(segments(texts, found)):
        new = ET.Element(f"{W}r")
        props = runs[source].find(f"{W}rPr")
        if props is not None:
            new.append(_copy(props))
        for n, piece in enumerate(re.split(r"([\t\n])", text)):
            if n % 2:
                ET.SubElement(new, f"{W}tab" if piece == "\t" else f"{W}br")
            elif piece:
                _set_text(ET.SubElement(new, f"{W}t"), piece)
        p.insert(at + k, new)
    return True


def _rewrite_draw(p, pairs) -> bool:
    """Runs are rebuilt where the first one stood, so properties stay first and the end mark last."""
    runs = p.findall(f"{A}r")
    texts = ["".join(t.text or "" for t in r.findall(f"{A}t")) for r in runs]
    full = "".join(texts)
    found = ranges(full, pairs) if full.strip() else []
    if not found:
        return False
    new = []
    for text, source in segments(texts, found):
        r = _copy(runs[source])
        ts = r.findall(f"{A}t") or [ET.SubElement(r, f"{A}t")]
        ts[0].text = text
        for t in ts[1:]:
            r.remove(t)
        new.append(r)
    at = list(p).index(runs[0])
    for r in runs:
        p.remove(r)
    for k, r in enumerate(new):
        p.insert(at + k, r)
    return True


def rewrite(pkg: Package, pairs: list[tuple[str, str]], alts: dict[str, str] | None = None) -> bytes:
    """The file with pairs applied to all text, alt texts looked up, the title masked and other metadata cleared."""
    touched: set[str] = set()

    def apply(part: str, paragraphs, change) -> None:
        for p in paragraphs:
            if change(p, pairs):
                touched.add(part)

    if pairs and pkg.kind == "docx":
        for part, body, title in _word_bodies(pkg):
            apply(part, body.findall(f"{W}p"), _rewrite_word)
            if title is None:
                for *_, paragraphs in _word_cells(body):
                    apply(part, paragraphs, _rewrite_word)
    elif pairs:
        for _, slide in _slides(pkg):
            for shape in _shapes(pkg.tree(slide).find(f"{P}cSld/{P}spTree")):
                for _, paragraphs in _shape_paragraphs(shape):
                    apply(slide, paragraphs, _rewrite_draw)
            for part, paragraphs in _notes(pkg, slide):
                apply(part, paragraphs, _rewrite_draw)
    for part, e, _ in _alt_elements(pkg) if alts else []:
        d = (e.get("descr") or "").strip()
        if d in alts:
            e.set("descr", alts[d])
            touched.add(part)
    core = "docProps/core.xml"
    if core in pkg.parts:
        touched.add(core)
        for e in pkg.tree(core):
            if e.tag == f"{DC}title":
                e.text = mask(e.text or "", pairs) if pairs else ""
            elif e.tag in (f"{DC}creator", f"{CP}lastModifiedBy", f"{DC}description", f"{CP}keywords", f"{DC}subject"):
                e.text = ""
    if pkg.kind == "docx" and "docProps/app.xml" in pkg.parts:
        for e in pkg.tree("docProps/app.xml"):
            if local(e.tag) == "Company" and e.text:
                e.text = ""
                touched.add("docProps/app.xml")
    return pkg.save(touched)


# Media folders, the grey of a scrubbed image and the blank vector image.
MEDIA = ("ppt/media/", "word/media/", "xl/media/")
GREY = (220, 220, 220)
BLANK_SVG = b'<svg xmlns="http://www.w3.org/2000/svg" width="100" height="100"><rect width="100%" height="100%" fill="#DCDCDC"/></svg>'
RASTER, OTHER = ("png", "jpg", "jpeg", "gif", "bmp", "tiff", "tif"), ("emf", "wmf", "wdp", "ico")


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF, BMP or JPEG."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:4] == b"GIF8":
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:2] == b"BM":
        return int.from_bytes(data[18:22], "little"), abs(int.from_bytes(data[22:26], "little", signed=True))
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                return None
            kind = data[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def flat_png(width: int, height: int, colour=GREY) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + b"\x08\x02\x00\x00\x00"
    row = b"\x00" + bytes(colour) * width
    press = zlib.compressobj(9)
    body = b"".join(press.compress(row) for _ in range(height)) + press.flush()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def flat_bmp(width: int, height: int, colour=GREY) -> bytes:
    row = bytes(colour[::-1]) * width + b"\x00" * (-3 * width % 4)
    size = 54 + len(row) * height
    head = b"BM" + size.to_bytes(4, "little") + b"\x00" * 4 + (54).to_bytes(4, "little") + (40).to_bytes(4, "little")
    return head + width.to_bytes(4, "little") + height.to_bytes(4, "little") + b"\x01\x00\x18\x00" + b"\x00" * 24 + row * height


def neutral(name: str, data: bytes) -> bytes | None:
    """Bytes that show nothing, of the size of the image; None for what is no image.

    PNG and BMP keep their format. Without an encoder for them here, the other raster formats become PNG bytes of the same size.
    """
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    if ext in RASTER:
        size = image_size(data) or (200, 200)
        return (flat_bmp if ext == "bmp" else flat_png)(max(1, size[0]), max(1, size[1]))
    if ext == "svg":
        return BLANK_SVG
    return flat_png(200, 200) if ext in OTHER else None


def scrub(content: bytes, only: set[str] | None = None) -> bytes:
    """The file with every embedded image (or the named parts) replaced by a neutral one."""
    pkg = Package(content)
    for name, data in pkg.parts.items():
        if name.startswith(MEDIA) and not name.endswith("/") and (only is None or name in only):
            new = neutral(name, data)
            if new is not None:
                pkg.parts[name] = new
    return pkg.save(set())
