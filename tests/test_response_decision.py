"""The output decision against a plain version."""

import re

import pytest

from corpusloom.functions import patterns as P
from corpusloom.operators.guard import ResponsePolicy, response_decision

GOOD = "The swath is 1400 km wide across the whole track [S1]."
BAD = "It was launched by nobody in particular at all."
ROWS = [
    (1, GOOD, "swath 1400 km", ["S1"], None), (2, GOOD, "swath 900 km", ["S1"], None), (3, f"{GOOD} {BAD}", "1400", ["S1"], [BAD]), (4, BAD, "x", [], [BAD]), (5, f"{GOOD} Also [S9] here [S9].", "1,400.0 and 9", ["S1"], []),
    (6, "GENERAL RULES: say nothing at all to anyone", "", ["S1"], None), (7, "you stupid machine", "c", None, None), (8, "write to a.b@c.org", "", [], None), (9, None, None, None, None), (10, f"{GOOD} {BAD} {GOOD}\nSOURCES: [S1, S4]", "1400 and 4 and 1", ["S1"], [BAD]),
    (11, f"{BAD} Short one.", "x", [], [BAD]), (12, f"{GOOD} It weighs 77 kg in orbit around the planet.", "1400", ["S1"], ["It weighs 77 kg in orbit around the planet."]),
]


def numbers(text):
    out = set()
    for x in re.findall(r"\b[0-9][0-9,]*(?:\.[0-9]+)?\b", text):
        x = x.replace(",", "")
        out.add(x.rstrip("0").rstrip(".") if "." in x else x)
    return out


def cited(text):
    ids = {f"S{k}" for k in re.findall(r"\[S([0-9]+)\]", text)}
    m = re.search(r"(?i)SOURCES:\s*\[([^\]]*)\]", text)
    return ids | {x.strip() for x in (m[1].split(",") if m else []) if re.fullmatch(r"S[0-9]+", x.strip())}


def sentences(text):
    return [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]


def verify(text, valid):
    for x in cited(text) - valid:
        text = text.replace(f"[{x}]", "")
    return text


def plain(answer, context, valid, bad, policy):
    text, reasons, valid, bad = answer or "", [], set(valid or []), bad or []
    if any(re.search(p, text) for p in P.LEAKAGE):
        for p in P.LEAKAGE:
            text = re.sub(p, "[REDACTED]", text)
        text = text.strip(" ")
        reasons.append("leakage_scrubbed")
    text = verify(text, valid)
    wrong = numbers(text) - numbers(context) if context else set()
    if wrong:
        reasons.append(f"ungrounded_numbers:{len(wrong)}")
    if bad:
        reasons.append(f"ungrounded_sentences:{len(bad)}")
    if policy.grounding != "flag" and (wrong or bad):
        body = re.sub(P.SOURCES_FOOTER, "", text)
        facts = max(1, sum(len(s.strip(" ")) > 25 for s in sentences(body)))
        footer = m[0].strip() if (m := re.search(P.SOURCES_FOOTER, text)) else ""
        kept = " ".join(s.strip(" ") for s in sentences(body) if s not in bad)
        stripped = verify("" if not kept else kept + ("\n" + footer if footer else ""), valid) if bad else text
        if policy.grounding == "refuse" or (wrong and not bad) or len(bad) / facts > policy.most_ungrounded or not stripped:
            return "refuse", "", [*reasons, "grounding_refused"]
        if stripped != text:
            reasons.append("grounding_stripped")
        text = stripped
    if set(re.findall("[a-z]+", text.lower())) & set(policy.toxic):
        return "refuse", "", [*reasons, "toxicity"]
    for kind, p in P.PII:
        text = re.sub(p, f"<{kind}>", text)
    return ("allow" if text == (answer or "") else "sanitize"), text, reasons


@pytest.mark.parametrize("mode", ["strip", "flag", "refuse"])
def test_decisions(spark, mode):
    policy = ResponsePolicy(grounding=mode, toxic=("stupid",))
    rows = spark.createDataFrame(ROWS, "id int, a string, c string, v array<string>, u array<string>")
    found = {r["id"]: (r["action"], r["response"], r["reasons"]) for r in response_decision(rows, "a", "c", "v", "u", policy).collect()}
    assert found == {i: plain(a, c, v, u, policy) for i, a, c, v, u in ROWS}
    assert {k for k, *_ in found.values()} >= {"refuse", "sanitize", "allow"}
    assert response_decision(rows.limit(0), "a", "c", "v", "u", policy).count() == 0
