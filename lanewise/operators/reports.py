"""Rows of the audit report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Labels and headings of the report.
NO_PLATE, REVIEW, HIGH, MEDIUM, DOUBTFUL = "SIN PLACA", "REVISIÓN MANUAL", "ALTA (SEGURA)", "MEDIA", "DUDOSA"
HEADINGS = (
    "Nº", "ID Evento", "Fecha y Hora", "Sentido", "Tipo", "Placa Raw", "Placa Validada", "Certeza Auditoría", "Consenso OCR",
    "Conf. OCR", "Estado Placa", "Foto Vehículo", "Recorte Placa", "Detalle / Reglas ANT", "Video Origen",
)
DUPLICATE_OF = "Duplicado De"


def vote_texts(votes: Column) -> Column:
    """Texts of a JSON array of votes, given as [text, confidence] or as objects with a text; empty if it isn't valid."""
    pairs = F.transform(F.from_json(votes, "array<array<string>>"), lambda v: F.get(v, F.lit(0)))
    objects = F.transform(F.from_json(votes, "array<struct<text:string>>"), lambda v: v["text"])
    return F.coalesce(F.when(votes.rlike(r"^\s*\[\s*\["), pairs), F.when(votes.rlike(r"^\s*\[\s*\{"), objects), F.array().cast("array<string>"))


def certainty(plate: Column, status: Column, confidence: Column, votes: Column, reason: Column) -> tuple[Column, Column]:
    """The certainty label and the consensus label of an event."""
    final = F.upper(F.trim(F.coalesce(plate, F.lit(""))))
    texts = vote_texts(votes)
    agree = F.size(F.filter(texts, lambda t: (t != "") & (F.upper(F.trim(t)) == final)))
    body = F.lower(F.coalesce(reason, F.lit(""))).rlike("carrocería|marca")
    label = (
        F.when((final == "") | (final == NO_PLATE) | (status == "PLACA_NO_DETECTADA"), NO_PLATE)
        .when(body | status.isin("REVISION_MANUAL", "FORMATO_INVALIDO"), REVIEW)
        .when(((agree >= 2) & (confidence >= 0.88)) | ((confidence >= 0.96) & (status == "OK")), HIGH)
        .when((confidence >= 0.75) & (status == "OK"), MEDIUM)
        .otherwise(DOUBTFUL)
    )
    consensus = (
        F.when(F.size(texts) > 0, F.concat_ws("", F.concat_ws("/", agree.cast("string"), F.size(texts).cast("string")), F.lit(" lecturas")))
        .when((final != "") & (final != NO_PLATE), "1 sola lectura")
        .otherwise("-")
    )
    return label, consensus


def report_rows(events: DataFrame, duplicates: bool = False) -> DataFrame:
    """The rows of one sheet in the order of time, numbered from 1.  A report is what a person reads: one day's events."""
    rows = events.where(F.col("duplicate_of").isNotNull() if duplicates else F.col("duplicate_of").isNull())
    label, consensus = certainty(*[F.col(c) for c in ("plate_corrected", "plate_status", "confidence_ocr", "ocr_votes", "plate_correction_reason")])
    return rows.select(
        F.row_number().over(Window.partitionBy("processing_run_id").orderBy("event_timestamp", "event_id")).alias("no"),
        "processing_run_id", "event_id", *(["duplicate_of"] if duplicates else []), "datetime_str", "direction", "vehicle_type", "plate_raw",
        F.coalesce("plate_corrected", F.lit(NO_PLATE)).alias("plate"), label.alias("certainty"), consensus.alias("consensus"),
        F.round("confidence_ocr", 2).alias("confidence_ocr"), "plate_status", "plate_correction_reason", "video_source",
    )
