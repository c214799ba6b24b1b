"""Places around centres at the poles and the date line, and letters on disk."""

import math
import os
import random

from jobloom.operators import nearby
from jobloom.sources import letters


def way(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * nearby.EARTH_KM * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def test_places_at_poles_and_date_line(spark):
    rng = random.Random(6)
    around = [(90, 0), (-90, 17), (89.9, 179.9), (0, 180), (0, -180), (47.4, 8.5), (-33, 179.99), (66, -179.95)]
    points = [(max(-90.0, min(90.0, a + rng.uniform(-1, 1))), (b + rng.uniform(-3, 3) + 180) % 360 - 180) for a, b in around for _ in range(40)]
    places = [(a, b, rng.choice(["city", "town", "hamlet"]), f"n{i}" if i % 9 else None, f"d{i}" if i % 4 == 0 else None) for i, (a, b) in enumerate(points)] + [(None, 1.0, "city", "x", None), (95.0, 1.0, "city", "y", None)]
    centres = [(i, float(a), float(b), r) for i, ((a, b), r) in enumerate((p, r) for p in around for r in (0, 15, 100, 500, None))] + [(99, None, 1.0, 5)]
    got = nearby.nearby(spark.createDataFrame(centres, "id long, lat double, lon double, radius_km int"), spark.createDataFrame(places, "lat double, lon double, kind string, name string, name_de string"))
    held = lambda r: 20 if r is None else max(1, min(100, r))
    want = {(i, g or n) for i, a, b, r in centres for c, d, kind, n, g in places if a is not None and c is not None and abs(c) <= 90 and kind != "hamlet" and (g or n) and way(a, b, c, d) <= held(r)}
    assert {(r["id"], r["name"]) for r in got.collect()} == want and len(want) > 50


def test_copies_make_no_pairs(spark):
    """Centres and places that stand in few spots many times; small radii look at small cubes."""
    at = ("47 + cast(id % 3 as double) / 100 AS lat", "8 + cast(id % 2 as double) / 100 AS lon")
    centres = spark.range(3000).selectExpr("id", *at, "cast(20 + id % 2 as int) AS radius_km").unionByName(spark.range(1).selectExpr("id + 5000 AS id", "47D AS lat", "9D AS lon", "1 AS radius_km"))
    places = spark.range(3000).selectExpr(*at, "'city' AS kind", "concat('n', id % 6) AS name", "'' AS name_de").unionByName(spark.range(1).selectExpr("47D AS lat", "9.5D AS lon", "'city' AS kind", "'far' AS name", "'' AS name_de"))
    assert nearby.candidates(nearby._asked(centres), places).count() == 6 * 6
    assert sorted(r["count"] for r in nearby.nearby(centres, places).groupBy("id").count().collect()) == [6] * 3000


def test_newest_letter_on_disk(spark, tmp_path):
    for i, name in enumerate(["2024_Firma_Techniker.docx", "Firma_2023.docx", "Firma_Techniker_neu.docx", "Firma_zuletzt.docx", "Techniker_Firma.docx", "Firma_Techniker.pdf", "Andere_Firm.docx"]):
        (tmp_path / name).write_bytes(b"x")
        os.utime(tmp_path / name, (1_700_000_000 + i, 1_700_000_000 + i))
    applications = spark.createDataFrame([(1, "Firma", "Techniker"), (2, "Firma", "Koch"), (3, "Keine", "Techniker"), (4, "", "Techniker"), (5, None, None), (6, "Firma", None)], "ord long, company string, title string")
    got = {r["ord"]: r["path"].rsplit("/", 1)[1] for r in letters.newest_letters(applications, letters.saved_letters(spark, str(tmp_path))).collect()}
    assert got == {1: "Firma_Techniker_neu.docx", 2: "Techniker_Firma.docx", 4: "Techniker_Firma.docx", 6: "Techniker_Firma.docx"}
