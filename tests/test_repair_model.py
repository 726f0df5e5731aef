"""The repair loop against a sequential model that validates the whole statement for every candidate."""

import random
import re

from ledgermill import constants as K
from ledgermill.operators import ledger, repair


def amount(raw):
    s = (raw or "").strip()
    if not s or "/" in s or s.count("-") > 1 or s.count(".") > 1:
        return 0
    t = re.sub(r"[^0-9.,-]", "", s).replace(",", "")
    try:
        return round(float(t) * 1000)
    except ValueError:
        return 0


def near(a, b):
    return abs(a - b) * 100_000 <= 1_000_000 + abs(b)


def readings(raw):
    s, out = raw.strip(), []
    out += [s[:i] + K.DIGITS[K.CONFUSED.index(c)] + s[i + 1 :] for i, c in enumerate(s) if c in K.CONFUSED]
    out += [s[:i] + s[i + 1] + s[i] + s[i + 2 :] for i in range(len(s) - 1) if s[i].isdigit() and s[i + 1].isdigit() and s[i] != s[i + 1]]
    d = re.sub(r"\D", "", s)
    out += [d[:-k] + "." + d[-k:] for k in range(1, min(4, len(d)))]
    good = []
    for c in out:
        try:
            float(re.sub(r"[^0-9.-]", "", c))
        except ValueError:
            continue
        if c != s and c not in good:
            good.append(c)
    return good


def judged(opening, closing, rows):
    parsed = [[amount(x) for x in r] for r in rows]
    best, top = None, -1
    for c, d in K.CONVENTIONS:
        prev, score = opening, 0
        for deb, cred, bal in parsed[:10]:
            score += near(bal, prev + c * cred + d * deb)
            prev = bal
        score += 100 * near(opening + c * sum(r[1] for r in parsed) + d * sum(r[0] for r in parsed), closing)
        if score > top:
            best, top = (c, d), score
    c, d = best
    run, prev, flagged, broken = opening, opening, [], []
    for i, (deb, cred, bal) in enumerate(parsed):
        run += c * cred + d * deb
        if not near(bal, run):
            flagged.append(i)
        if not near(bal, prev + c * cred + d * deb):
            broken.append(i)
        prev = bal
    return near(run, closing), flagged, broken


def model(opening, closing, rows):
    rows, log = [list(r) for r in rows], []
    for number in (1, 2):
        _, flagged, broken = judged(opening, closing, rows)
        if not flagged:
            break
        at = broken[0] if broken else flagged[0]
        hit = None
        for k in range(3):
            raw = rows[at][k]
            if not raw or raw.lower() == "none" or raw == "0.0":
                continue
            for cand in readings(raw):
                trial = [list(r) for r in rows]
                trial[at][k] = cand
                if judged(opening, closing, trial)[0]:
                    hit = (k, raw, cand)
                    break
            if hit:
                break
        if not hit:
            break
        rows[at][hit[0]] = hit[2]
        log.append((number, at, *hit))
    return rows, log


def test_repair_like_the_sequential_model(spark):
    rng = random.Random(8)
    statements, bounds, expected = [], [], {}
    for k in range(40):
        c, d = rng.choice(K.CONVENTIONS)
        opening = balance = rng.randint(100, 9000) * 1000
        rows = []
        for _ in range(rng.randint(1, 14)):
            deb, cred = (rng.randint(1, 99999) * 10, 0) if rng.random() < 0.5 else (0, rng.randint(1, 99999) * 10)
            balance += c * cred + d * deb
            show = lambda v: f"{v / 1000:.2f}" if v else rng.choice(["", "0.0"])
            rows.append([show(deb), show(cred), f"{balance / 1000:.2f}"])
        for _ in range(rng.choice([0, 1, 1, 2])):  # misread cells
            r, f = rng.choice(rows), rng.randint(0, 2)
            r[f] = r[f].translate(str.maketrans(dict(zip("015", "OlS", strict=True)))) if rng.random() < 0.6 else r[f].replace(".", "", 1)
        closing = balance + rng.choice([0, 0, 0, 5_000_000])
        statements += [(k, i, *r) for i, r in enumerate(rows)]
        bounds.append((k, opening, closing))
        expected[k] = model(opening, closing, rows)
    df = spark.createDataFrame(statements, "statement_id long, seq int, debit_raw string, credit_raw string, balance_raw string")
    fixed, log = repair.repair(df, spark.createDataFrame(bounds, "statement_id long, opening long, closing long"))
    got_log = sorted((r["statement_id"], r["reason"][-1], r["seq"], r["field"], r["raw_value"], r["corrected_value"]) for r in log.collect())
    assert got_log == sorted((k, str(n), at, K.AMOUNT_FIELDS[f], raw, cand) for k, (_, lines) in expected.items() for n, at, f, raw, cand in lines)
    got = {}
    for r in fixed.orderBy("statement_id", "seq").collect():
        got.setdefault(r["statement_id"], []).append([r["debit_raw"], r["credit_raw"], r["balance_raw"]])
    assert got == {k: rows for k, (rows, _) in expected.items()}
    assert ledger.conventions(ledger.parse_rows(fixed, 1000), spark.createDataFrame(bounds, "statement_id long, opening long, closing long"), 1000).count() == 40
