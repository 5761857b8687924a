"""Conversion-log parsing and the per-document fold vs a transcribed loop."""

import random

from helpers import lines_df
from sheaf.functions.convlog import parse_convlog
from sheaf.operators import conversions as cv


def fold_loop(events):
    """Specification, evaluated per document over the whole event list (test oracle)."""
    ev = list(events)
    pos = {id(e): i for i, e in enumerate(ev)}
    attempts = [e for e in ev if e["event_type"] == "ATTEMPT"]
    created = {}
    for e in attempts:
        created.setdefault(e["filename"], pos[id(e)])

    def current(i):
        before = [e for e in attempts if pos[id(e)] <= i]
        return before[-1]["filename"] if before else None

    def scan_target(e):
        i, name = pos[id(e)], e["filename"]
        hits = [(c, f) for f, c in created.items() if c < i and (name in f or f in name)]
        return min(hits)[1] if hits else current(i)

    out = {}
    for f, c in created.items():
        mine = [e for e in attempts if e["filename"] == f]
        sizes = [e["input_size"] for e in mine if e["input_size"] is not None]
        scans = [e for e in ev if e["event_type"] == "LINK_SCAN" and scan_target(e) == f]
        done = [e for e in ev if (e["event_type"] == "SUCCESS" and current(pos[id(e)]) == f)
                or (e["event_type"] == "CONVERTED" and e["filename"] == f and c < pos[id(e)])]
        conv = [e for e in done if e["event_type"] == "CONVERTED"]
        out[f] = dict(file_type=mine[0]["file_type"], attempt=mine[-1]["attempt"], size=sizes[-1] if sizes else None,
                      links=scans[-1]["links_found"] if scans else 0, types=scans[-1]["link_types"] if scans else [],
                      ok=bool(done), pdf=done[-1]["pdf_size"] if done else None,
                      time=conv[-1]["conversion_time"] if conv else None)
    return out


def test_parse_priority_and_fields(spark):
    lines = ["[2026-01-01 10:00:00] [ENTRY] convert_office_to_pdf called: type=excel, size=1.5MB, max_retries=2",
             "2026-01-01 10:00:01 [Attempt 1/2] Converting excel_input_a_input_b.xlsx (1.50MB)...",
             "[LINK_SCAN] file=\"x.xlsx\" external_links_found=2 link_types=['ole', '', \"chart\", '''']",
             "[SUCCESS] excel conversion completed, PDF size: 0.75MB Converted excel_input_q.xlsx to PDF (0.80MB) in 3.0s",
             "nothing"]
    ev = {r.line_no: r for r in parse_convlog(lines_df(spark, lines)).collect()}
    assert ev[0].event_type == "ENTRY" and ev[0].file_type == "excel"
    assert ev[1].filename == "excel_input_a_input_b.xlsx" and ev[1].file_type == "excel_input_a" and ev[1].timestamp == "2026-01-01 10:00:01"
    assert ev[2].link_types == ["ole", "", "chart", ""] and ev[2].timestamp is None  # '' stays: blank test precedes quote strip (P4)
    # the later pattern gives the event; fields that only the earlier one has stay
    assert ev[3].event_type == "CONVERTED" and ev[3].pdf_size == 0.8 and ev[3].file_type == "excel" and ev[3].filename == "excel_input_q.xlsx"
    assert 4 not in ev


def test_success_before_attempt_and_fallback(spark):
    lines = ["[SUCCESS] excel conversion completed, PDF size: 1.00MB",
             "[Attempt 1/2] Converting excel_input_one.xlsx (1.00MB)...",
             "[LINK_SCAN] file='zzz' external_links_found=3 link_types=['ole']",
             "Converted excel_input_nothere.xlsx to PDF (1.00MB) in 1.0s"]
    rec = cv.conversion_records(parse_convlog(lines_df(spark, lines))).collect()
    assert len(rec) == 1
    r = rec[0]
    assert r.conversion_successful is False and r.links_found == 3 and r.has_links  # scan falls back to current file


def test_fold_matches_loop(spark):
    rnd = random.Random(11)
    names = ["excel_input_a.xlsx", "excel_input_ab.xlsx", "powerpoint_input_b.pptx", "word_input_c.docx"]
    lines = []
    for _ in range(300):
        n = rnd.choice(names)
        k = rnd.random()
        if k < 0.3:
            lines.append(f"[Attempt {rnd.randint(1, 2)}/2] Converting {n} ({rnd.randint(1, 9)}.00MB)...")
        elif k < 0.55:
            scan = rnd.choice([n, n[6:], "a.xlsx", "b", "zz", "input_"])
            lines.append(f"[LINK_SCAN] file='{scan}' external_links_found={rnd.randint(0, 3)} link_types=['ole']")
        elif k < 0.75:
            lines.append(f"[SUCCESS] excel conversion completed, PDF size: {rnd.randint(1, 9)}.00MB")
        else:
            lines.append(f"Converted {n} to PDF ({rnd.randint(1, 9)}.00MB) in {rnd.randint(1, 9)}.0s")
    df = lines_df(spark, lines)
    ev = parse_convlog(df)
    evs = [r.asDict() for r in ev.orderBy("line_no").collect()]
    want = fold_loop(evs)
    got = {r.filename: r for r in cv.conversion_records(ev).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        g = got[k]
        assert (g.attempt_number, g.input_size_mb, g.links_found, g.link_types, g.conversion_successful,
                g.pdf_size_mb, g.conversion_time_seconds) == (w["attempt"], w["size"], w["links"], w["types"], w["ok"],
                                                               w["pdf"], w["time"]), k
