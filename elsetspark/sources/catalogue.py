"""The pinned satellites: crosswalks from the operators' names, and the recipe of objects to rebuild.

About ninety rows. dims() and recipe() are DataFrames for joins; the lists are fixed facts of the catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Public catalogue numbers of the satellites whose manoeuvres are announced or derived.
# GPS: space vehicle, PRN, catalogue number, block.
GPS = """
44 22 26407 IIR
48 7 32711 IIR-M
50 5 35752 IIR-M
52 31 29486 IIR-M
53 17 28874 IIR-M
55 15 32260 IIR-M
56 16 27663 IIR
57 29 32384 IIR-M
58 12 29601 IIR-M
59 19 28190 IIR
61 2 28474 IIR
62 25 36585 IIF
64 30 39533 IIF
65 24 38833 IIF
66 27 39166 IIF
67 6 39741 IIF
68 9 40105 IIF
69 3 40294 IIF
70 32 41328 IIF
71 26 40534 IIF
72 8 40730 IIF
73 10 41019 IIF
74 4 43873 III
75 18 44506 III
76 23 45854 III
77 14 46826 III
78 11 48859 III
79 28 55268 III
80 1 62339 III
81 21 64202 III
82 20 67588 III
83 13 68791 III
"""
# Galileo: GSAT, catalogue number, name.
GALILEO = """
GSAT0101 37846 GALILEO-PFM
GSAT0102 37847 GALILEO-FM2
GSAT0103 38857 GALILEO-FM3
GSAT0201 40128 GALILEO 5
GSAT0202 40129 GALILEO 6
GSAT0203 40544 GALILEO 7
GSAT0204 40545 GALILEO 8
GSAT0205 40889 GALILEO 9
GSAT0206 40890 GALILEO 10
GSAT0208 41175 GALILEO 11
GSAT0209 41174 GALILEO 12
GSAT0210 41550 GALILEO 13
GSAT0211 41549 GALILEO 14
GSAT0207 41859 GALILEO 15
GSAT0212 41860 GALILEO 16
GSAT0213 41861 GALILEO 17
GSAT0214 41862 GALILEO 18
GSAT0215 43055 GALILEO 19
GSAT0216 43056 GALILEO 20
GSAT0217 43057 GALILEO 21
GSAT0218 43058 GALILEO 22
GSAT0219 43566 GALILEO 23
GSAT0220 43567 GALILEO 24
GSAT0221 43564 GALILEO 25
GSAT0222 43565 GALILEO 26
GSAT0223 49809 GALILEO 27
GSAT0224 49810 GALILEO 28
GSAT0225 59598 GALILEO 29
GSAT0226 61183 GALILEO 31
GSAT0227 59600 GALILEO 30
GSAT0232 61182 GALILEO 32
GSAT0233 67160 GALILEO 33
GSAT0234 67162 GALILEO 34
"""
# QZSS: name, catalogue number, class, file of the operation history.
QZSS = """
QZS-2 42738 IGSO qzs2
QZS-4 42965 IGSO qzs4
QZS-1R 49336 IGSO qzs1r
QZS-3 42917 GEO qzs3
QZS-6 62876 GEO qzs6
"""
# GOES and geostationary satellites without notices: name, catalogue number.
GOES = """
GOES-16 41866
GOES-17 43226
GOES-18 51850
GOES-19 60133
"""
SELF_GEO = """
Meteosat-10 38552
Himawari-8 40267
Meteosat-11 40732
"""
# DORIS: code, catalogue number, file of the manoeuvre history, name.
DORIS = """
TOPEX 22076 top TOPEX/Poseidon
JASO1 26997 ja1 Jason-1
JASO2 33105 ja2 Jason-2
JASO3 41240 ja3 Jason-3
ENVI1 27386 en1 Envisat
CRYO2 36508 cs2 CryoSat-2
SARAL 39086 srl SARAL
HY-2A 37781 h2a HY-2A
SEN3A 41335 s3a Sentinel-3A
SEN3B 43437 s3b Sentinel-3B
SEN6A 46984 s6a Sentinel-6A
SPOT2 20436 sp2 SPOT-2
SPOT3 22823 sp3 SPOT-3
SPOT4 25260 sp4 SPOT-4
SPOT5 27421 sp5 SPOT-5
"""
VERSION = "0.3.0"
SCHEMA = "norad_id long, orbit_class string, object_name string, catalogue_source string, label_source string, label_ref string, code string"


def _rows(text: str, fields: int) -> list[list[str]]:
    return [line.split(maxsplit=fields - 1) for line in text.strip().splitlines()]


def _entries() -> list[tuple]:
    """norad_id, class, name, source of labels, their reference, and the code that notices use."""
    out = [(int(i), "LEO", name, "DORIS-IDS", ref, code) for code, i, ref, name in _rows(DORIS, 4)]
    out += [(int(i), "MEO", f"GPS SVN{svn} (PRN{prn}, {block})", "GPS-NANU", f"SVN{svn}", f"SVN{svn}") for svn, prn, i, block in _rows(GPS, 4)]
    out += [(int(i), "MEO", f"Galileo {gsat} ({name})", "GALILEO-NAGU", gsat, gsat) for gsat, i, name in _rows(GALILEO, 3)]
    out += [(int(i), kind, f"QZSS {name}", "QZSS-OHI", ref, ref) for name, i, kind, ref in _rows(QZSS, 4)]
    out += [(int(i), "GEO", name, "NOAA-GOES", name, name) for name, i in _rows(GOES, 2)]
    return out + [(int(i), "GEO", name, "SELF-GEO", "", None) for name, i in _rows(SELF_GEO, 2)]


def recipe(spark: SparkSession) -> DataFrame:
    """The objects to rebuild and where their labels come from, by catalogue number. code: the name in the operator's notices."""
    rows = sorted((i, kind, name, "spacetrack", source, ref, code) for i, kind, name, source, ref, code in _entries())
    return spark.createDataFrame(rows, SCHEMA).orderBy("norad_id")


def crosswalk_of(spark: SparkSession, source: str) -> DataFrame:
    """code, norad_id of one source of labels: the dimension that notices.crosswalk joins."""
    out = recipe(spark).where((F.col("label_source") == source) & F.col("code").isNotNull()).select("code", "norad_id")
    if out.isEmpty():
        raise ValueError(f"no notices of source {source!r}")
    return out
