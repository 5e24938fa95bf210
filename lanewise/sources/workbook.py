"""The audit report as a workbook, written with the standard library.

A report is for people: its rows are one run's events, collected on the driver up to a stated number; more rows are
refused, and go to Parquet or CSV instead.
"""

from __future__ import annotations

import posixpath
import zipfile
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reports

MAX_ROWS = 100_000
#: Bytes of pictures that one report may hold; more are refused.
MAX_PICTURES = 256 << 20
#: The size that pictures are shown in, in pixels.
SHOWN = (160, 110)
SHEETS = ("Auditoria Transito", "Duplicados Descartados")
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_REL = "http://schemas.openxmlformats.org/package/2006/relationships"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_PART = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_DRAW = "http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing"
_ART = "http://schemas.openxmlformats.org/drawingml/2006/main"
#: The headings of the pictures' columns, and the columns of pictures shown there.
PICTURES = {"Foto Vehículo": "vehicle_png", "Recorte Placa": "plate_png"}


def _letters(k: int) -> str:
    out = ""
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def _drawing(pictures: list[tuple[int, int, bytes]]) -> str:
    """Pictures at (row, column), both from 0, scaled into the size they are shown in."""
    parts = []
    for k, (row, col, data) in enumerate(pictures, 1):
        w, h = int.from_bytes(data[16:20]), int.from_bytes(data[20:24])
        scale = min(SHOWN[0] / w, SHOWN[1] / h, 1.0)
        parts.append(
            f'<xdr:oneCellAnchor><xdr:from><xdr:col>{col}</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>{row}</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:from>'
            f'<xdr:ext cx="{max(1, int(w * scale)) * 9525}" cy="{max(1, int(h * scale)) * 9525}"/><xdr:pic><xdr:nvPicPr><xdr:cNvPr id="{k}" name="p{k}"/><xdr:cNvPicPr/></xdr:nvPicPr>'
            f'<xdr:blipFill><a:blip r:embed="r{k}"/><a:stretch><a:fillRect/></a:stretch></xdr:blipFill>'
            '<xdr:spPr><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></xdr:spPr></xdr:pic><xdr:clientData/></xdr:oneCellAnchor>'
        )
    return f'<?xml version="1.0" encoding="UTF-8"?><xdr:wsDr xmlns:xdr="{_DRAW}" xmlns:a="{_ART}" xmlns:r="{_DOC}">{"".join(parts)}</xdr:wsDr>'


def _sheet(heads: list[str], rows: list[tuple], drawn: bool = False) -> str:
    def cell(r: int, c: int, v) -> str:
        at = f"{_letters(c)}{r}"
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{at}"><v>{v}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    lines = [f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row, 1))}</row>' for r, row in enumerate([heads, *rows], 1)]
    span = f"A1:{_letters(len(heads))}{len(rows) + 1}"
    end = '<drawing r:id="r1"/>' if drawn else ""
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheetData>{"".join(lines)}</sheetData><autoFilter ref="{span}"/>{end}</worksheet>'


def write(path: str, sheets: dict[str, tuple[list[str], list[tuple]]], pictures: dict[str, list[tuple[int, int, bytes]]] | None = None) -> None:
    """Sheets by name as (headings, rows), and each sheet's PNG pictures as (row, column, bytes), both from 0."""
    names, shown, n = list(sheets), pictures or {}, 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{_PART}.worksheet+xml"/>' for k in range(1, len(names) + 1))
        over += "".join(f'<Override PartName="/xl/drawings/drawing{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.drawing+xml"/>' for k, s in enumerate(names, 1) if shown.get(s))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/><Override PartName="/xl/workbook.xml" ContentType="{_PART}.sheet.main+xml"/>{over}</Types>')
        related = lambda at, rows: z.writestr(at, f'<?xml version="1.0"?><Relationships xmlns="{_REL}">' + "".join(f'<Relationship Id="{r}" Type="{_DOC}/{kind}" Target="{to}"/>' for r, kind, to in rows) + "</Relationships>")
        related("_rels/.rels", [("r1", "officeDocument", "xl/workbook.xml")])
        tabs = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets>{tabs}</sheets></workbook>')
        related("xl/_rels/workbook.xml.rels", [(f"r{k}", "worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(names) + 1)])
        for k, name in enumerate(names, 1):
            own = shown.get(name) or []
            z.writestr(f"xl/worksheets/sheet{k}.xml", _sheet(*sheets[name], drawn=bool(own)))
            if own:
                related(f"xl/worksheets/_rels/sheet{k}.xml.rels", [("r1", "drawing", f"../drawings/drawing{k}.xml")])
                z.writestr(f"xl/drawings/drawing{k}.xml", _drawing(own))
                related(f"xl/drawings/_rels/drawing{k}.xml.rels", [(f"r{j}", "image", f"../media/image{n + j}.png") for j in range(1, len(own) + 1)])
                for _, _, data in own:
                    n += 1
                    z.writestr(f"xl/media/image{n}.png", data)


def _held(pictures: DataFrame, rows: list) -> dict[str, tuple]:
    """The pictures of a sheet's events, after a look at how many bytes they are."""
    ids = pictures.sparkSession.createDataFrame([(r.event_id,) for r in rows], "event_id string")
    own = pictures.join(F.broadcast(ids), "event_id", "left_semi").select("event_id", *PICTURES.values())
    size = own.agg(F.sum(sum(F.coalesce(F.length(c), F.lit(0)) for c in PICTURES.values())).alias("n")).first().n or 0
    if size > MAX_PICTURES:
        raise ValueError(f"a workbook holds at most {MAX_PICTURES} bytes of pictures")
    return {r.event_id: r for r in own.collect()}


def export(events: DataFrame, path: str, pictures: DataFrame | None = None) -> list[str]:
    """Writes the report of one run's events; the second sheet exists only if there are duplicates.  Returns the names.

    pictures(event_id, vehicle_png, plate_png), a row for each event that has some, fill the two columns of pictures;
    without them those columns are left out.
    """
    out, drawn = {}, {}
    for name, duplicates in zip(SHEETS, (False, True), strict=True):
        rows = reports.report_rows(events, duplicates).drop("processing_run_id").orderBy("no").limit(MAX_ROWS + 1).collect()
        if len(rows) > MAX_ROWS:
            raise ValueError(f"a workbook holds at most {MAX_ROWS} events")
        if rows or not duplicates:
            heads = list(reports.HEADINGS)
            if duplicates:
                heads.insert(2, reports.DUPLICATE_OF)
            if pictures is None:
                out[name] = [h for h in heads if h not in PICTURES], [tuple(r) for r in rows]
                continue
            at = heads.index(next(iter(PICTURES)))
            out[name] = heads, [(*r[:at], *[None] * len(PICTURES), *r[at:]) for r in rows]
            held = _held(pictures, rows) if rows else {}
            drawn[name] = [
                (k, heads.index(h), bytes(held[r.event_id][c])) for k, r in enumerate(rows, 1) for h, c in PICTURES.items() if r.event_id in held and held[r.event_id][c]
            ]
    write(path, out, drawn)
    return list(out)


def extract(path: str, folder: str) -> list[str]:
    """Writes the pictures of a report as EVENT_veh and EVENT_plate below a folder; returns the files' names.

    A picture belongs to the event in the second column of the row that it is anchored to.
    """
    target, found = Path(folder), []
    target.mkdir(parents=True, exist_ok=True)
    tags = {"Foto Vehículo": "veh", "Recorte Placa": "plate"}
    with zipfile.ZipFile(path) as z:
        has = set(z.namelist())

        def links(part: str) -> dict[str, str]:
            base, leaf = posixpath.split(part)
            at = f"{base}/_rels/{leaf}.rels"
            rows = ElementTree.fromstring(z.read(at)) if at in has else []
            return {r.get("Id"): posixpath.normpath(posixpath.join(base, r.get("Target"))).lstrip("/") for r in rows}

        for part in links("xl/workbook.xml").values():
            if "worksheets/" not in part or part not in has:
                continue
            sheet = ElementTree.fromstring(z.read(part))
            cells = {c.get("r"): "".join(t.text or "" for t in c.iter(f"{{{_MAIN}}}t")) for c in sheet.iter(f"{{{_MAIN}}}c")}
            for drawing in [p for p in links(part).values() if "drawings/" in p and p.endswith(".xml")]:
                images = links(drawing)
                for anchor in ElementTree.fromstring(z.read(drawing)):
                    start, blip = anchor.find(f"{{{_DRAW}}}from"), next(anchor.iter(f"{{{_ART}}}blip"), None)
                    if start is None or blip is None:
                        continue
                    row, col = (int(start.find(f"{{{_DRAW}}}{k}").text) for k in ("row", "col"))
                    event, tag = cells.get(f"B{row + 1}"), tags.get(cells.get(f"{_letters(col + 1)}1"))
                    image = images.get(blip.get(f"{{{_DOC}}}embed"))
                    if event and tag and image in has and not set(event) & set("/\\"):
                        name = f"{event}_{tag}{posixpath.splitext(image)[1]}"
                        (target / name).write_bytes(z.read(image))
                        found.append(name)
    return found
