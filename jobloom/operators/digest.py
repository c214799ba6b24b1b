"""Texts of a digest: plain list, short summary and HTML body, each from at most a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import present


def escaped(text: Column) -> Column:
    for sign, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(by))
    return text


def centred(text: Column, width: int) -> Column:
    """Blanks on both sides, one more on the right; longer texts stay."""
    n = F.length(text)
    left = F.concat(F.repeat(F.lit(" "), ((F.lit(width) - n) / 2).cast("int")), text)
    return F.when(n >= width, text).otherwise(F.rpad(left, width, " "))


def joined(rows: DataFrame, text: Column, glue: str, empty: str, place: str = "place") -> DataFrame:
    """One row: the texts in their order. The rows must be few."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), text.alias("t")))), lambda x: x["t"]), glue)
    return rows.agg(F.coalesce(F.nullif(whole, F.lit("")), F.lit(empty)).alias("body"))


def plain_list(rows: DataFrame, top: int = 20) -> DataFrame:
    """Rows (place, match, title, company, location, link) as a numbered list of two lines each."""
    text = F.format_string("%02d. [%s] %s - %s - %s\n    %s", F.col("place").cast("int"), centred(present(F.col("match")), 5), *(present(F.col(c)) for c in ("title", "company", "location", "link")))
    return joined(rows.filter(F.col("place") <= top), text, "\n", "Keine Treffer.")


def summary(rows: DataFrame, top: int = 3, most: int = 4000) -> DataFrame:
    """Counts of the sections and the first new rows (place counts within a section)."""
    line = F.format_string("- %s @ %s (%s)", *(present(F.col(c)) for c in ("title", "company", "location")))
    first = F.when((F.col("section") == "new") & (F.col("place") <= top), F.struct("place", line.alias("t")))
    said = rows.agg(F.count_if(F.col("section") == "new").alias("new"), F.count_if(F.col("section") == "reminder").alias("open"), F.array_sort(F.collect_list(first)).alias("rows"))
    body = F.array_join(F.concat(F.array(F.format_string("Job-Alert: %d neu, %d offen", "new", "open")), F.transform("rows", lambda x: x["t"])), "\n")
    return said.select(F.left(body, F.lit(most)).alias("body"))


def html_items(rows: DataFrame, most: int = 200) -> DataFrame:
    """Rows shown in the HTML body with their item; new rows go first where ``most`` cuts."""
    from pyspark.sql import Window

    shown = rows.orderBy(F.col("section") != "new", "place").limit(most)
    meta = F.concat_ws(" | ", *(F.concat(F.lit(label), F.nullif(F.col(c).cast("string"), F.lit(""))) for label, c in (("ID ", "uid"), ("", "date"), ("", "source"), ("", "match"), ("Score ", "score"))))
    link = F.nullif(F.col("link"), F.lit(""))
    item = F.concat(
        F.lit("<li><strong>"), escaped(present(F.col("title"))), F.lit("</strong> bei "), escaped(present(F.col("company"))), F.lit("<br><em>"), escaped(present(F.col("location"))), F.lit("</em><br>"),
        F.when(meta != "", F.concat(F.lit("<small>"), escaped(meta), F.lit("</small><br>"))).otherwise(""),
        F.lit('<a href="'), F.coalesce(escaped(link), F.lit("#")), F.lit('">'), F.when(link.isNotNull(), "Bewerben").otherwise("Kein Link vorhanden"), F.lit("</a></li>"),
    )
    return shown.select("section", F.row_number().over(Window.orderBy(F.col("section") != "new", "place")).alias("place"), item.alias("item"))


def html_body(rows: DataFrame, most: int = 200) -> DataFrame:
    """One row: the body with both sections and a note of how many rows are left out."""
    counts = rows.agg(F.count_if(F.col("section") == "new").alias("new"), F.count_if(F.col("section") == "reminder").alias("open"))
    items = F.array_sort(F.collect_list(F.struct("place", "section", "item")))
    shown = html_items(rows, most).agg(items.alias("items"))

    def section(name: str, empty: str) -> Column:
        own = F.array_join(F.transform(F.filter("items", lambda x: x["section"] == name), lambda x: x["item"]), "")
        return F.coalesce(F.nullif(own, F.lit("")), F.lit(f"<li>{empty}</li>"))

    left = F.greatest(F.col("new") + F.col("open") - most, F.lit(0))
    note = F.when(left > 0, F.format_string("<p>... und %d weitere Stellen (nicht angezeigt wegen Mengenlimit)</p>", left)).otherwise("")
    body = F.concat(
        F.format_string("<html><body><h2>Job-Alert</h2><p>Neu: %d | Offen: %d</p><h3>NEW</h3><ul>", "new", "open"), section("new", "Keine neuen Jobs."),
        F.lit("</ul><h3>OPEN REMINDERS</h3><ul>"), section("reminder", "Keine offenen Erinnerungen."), F.lit("</ul>"), note, F.lit("</body></html>"),
    )
    return counts.join(F.broadcast(shown)).select(body.alias("body"))


# The weekly counts with their names, and what is said if one is missing
WEEKLY = (("total_searched", "Gesuchte Jobs", "0"), ("new_jobs", "Neue Jobs gefunden", "0"), ("applications_sent", "Bewerbungen gesendet", "0"), ("errors", "Fehler aufgetreten", "0"), ("last_search", "Letzte Suche", "N/A"))
SENT_BY = "<p><em>Diese E-Mail wurde automatisch vom Job-Finder generiert.</em></p></body></html>"


def weekly_body(stats: DataFrame) -> Column:
    """The body of a weekly summary for rows with the counts of ``WEEKLY``; without blanks between its elements."""
    said = lambda name, default: F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in stats.columns else F.lit(default)
    items = [F.concat(F.lit(f"<li><strong>{label}:</strong> "), said(name, default), F.lit("</li>")) for name, label, default in WEEKLY]
    head = "<html><body><h2>Wöchentliche Job-Suche Zusammenfassung</h2><p>Hier ist Ihre wöchentliche Übersicht der Job-Suche Aktivitäten:</p><ul>"
    return F.concat(F.lit(head), *items, F.lit("</ul>" + SENT_BY))


def error_body(kind: Column, message: Column, trace: Column) -> Column:
    """The body of an error's mail, with its trace if there is one; without blanks between its elements."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    style = "background-color: #f5f5f5; padding: 10px; border: 1px solid #ccc;"
    shown = F.when(trace != "", F.concat(F.lit(f'<p><strong>Traceback:</strong></p><pre style="{style}">'), trace, F.lit("</pre>"))).otherwise("")
    return F.concat(
        F.lit('<html><body><h2 style="color: red;">Kritischer Fehler im Job-Finder</h2><p><strong>Fehlertyp:</strong> '), text(kind), F.lit("</p><p><strong>Nachricht:</strong> "), text(message),
        F.lit("</p>"), shown, F.lit("<p>Bitte überprüfen Sie die Logs für weitere Details.</p>" + SENT_BY),
    )
