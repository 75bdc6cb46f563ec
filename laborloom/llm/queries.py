"""Registry of the queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import canonical, cooccurrence, history, leakage, names, packing, segments, sentences, survivors

QUERIES = {
    "p1_found": survivors.p1_found,
    "p1_survivors": survivors.p1_survivors,
    "p3_found": names.p3_found,
    "p5_found": cooccurrence.p5_found,
    "p5_surprise": cooccurrence.p5_surprise,
    "p6_found": history.p6_found,
    "p6_batches": segments.p6_batches,
    "p7_found": canonical.p7_found,
    "p8_windows": packing.p8_windows,
    "p9_found": leakage.p9_found,
    "p10_found": sentences.p10_found,
}
SQL = {"p5_found": cooccurrence.FOUND_SQL}
