"""Sections and lines against plain loops over the lines of odd texts."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import sections as S

r = random.Random(15)


def fold(s):
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))


def short(item):
    item = re.sub(r"\s+", " ", item).strip()[:540].strip()
    return item if len(item) <= 180 else (item[:180].rsplit(" ", 1)[0].strip() if " " in item[:180] else item[:180])


def plain_sections(text):
    out, is_open = {k: [] for k in S.KINDS}, ""
    for line in (text or "").splitlines():
        head = re.sub(r"\s+", " ", re.sub(S.SIGNS, "", line).strip().strip(S.BRACKETS)).strip()
        raw = line
        for kind, patterns in S.KINDS.items():
            if m := re.match(rf"(?:{'|'.join(patterns)})\s*:?\s*(.*)$", head, re.IGNORECASE):
                is_open, raw = kind, m[1]
                break
        else:
            if re.match(rf"(?:{'|'.join(S.OTHER)})\s*:?\s*$", line.strip(), re.IGNORECASE):
                is_open = ""
        item = short(re.sub(r"^\d+[.)]\s+", "", re.sub(S.SIGNS, "", raw).strip())) if is_open else ""
        if item and len(out[is_open]) < 6 and item.lower() not in map(str.lower, out[is_open]):
            out[is_open].append(item)
    return tuple(map(tuple, out.values()))


HEADS = ["Requirements", "## What you'll need to succeed:", "*Tasks*", "【必須要件】", "담당업무: first", "Benefits", "About us", "about the team:", "RESPONSIBILITIES :  lead", "In this role, you’ll get to build", "• Qualifications"]
BODY = ["- one", "1. One", "ONE", "", "   ", "* " + "long words " * 40, "x" * 300, "2) two\t words", "three", "four", "five", "six", "seven", "eight \x85nine", "about", "salary of all"]


def test_headed_sections(spark):
    texts = [None, "", "no heading\nat all", "Requirements"] + ["\n".join(r.choice(HEADS) if r.random() < 0.3 else r.choice(BODY) for _ in range(r.randrange(40))).replace("\n", r.choice(["\n", "\r\n", "\r"])) for _ in range(150)]
    texts.append("tasks\n" + "\n".join(f"{i} item" for i in range(20_000)) + "\nBenefits\nnone")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.headed_sections(F.col("t")).alias("s"))
    assert {x.i: tuple(map(tuple, x.s)) for x in df.collect()} == {i: plain_sections(t) for i, t in enumerate(texts)}


def test_sections_redact(spark):
    got = spark.createDataFrame([("Tasks\n- mail a@b.org or +54 11 5555-1234\nsee https://x.y/z now",)], "t string").select(S.headed_sections(F.col("t")).alias("s")).first().s
    assert got.responsibilities == ["mail [redacted-email] or [redacted-phone]", "see [redacted-url] now"] and got.candidate_expectations == []


@pytest.mark.parametrize(("text", "want"), [
    (None, ("", "", "")), ("  \n ", ("", "", "")), (" just text \n", ("", "", "just text")),
    ("before\nReasoning:\n  a \n\n b\nConclusion\nc\nFINAL RESPONSE::\nd\n\ne  \nreasoning\nz", ("a\n b\nz", "c", "d\ne")),
    ("Reasoning about conclusion\nand final response", ("", "", "")),
    ("See [A b](https://H.example/x) and [A b](https://h.example/y) [C](http://c.example)\n sources : \n- x", ("Leyendo estas fuentes y extrayendo lo relevante:\n- A b (h.example)\n- C (c.example)", "", "See [A b](https://H.example/x) and [A b](https://h.example/y) [C](http://c.example)")),
    ("".join(f"[t{i}](http://h{i}.example) " for i in range(12)), ("Leyendo estas fuentes y extrayendo lo relevante:\n" + "\n".join(f"- t{i} (h{i}.example)" for i in range(8)), "", "".join(f"[t{i}](http://h{i}.example) " for i in range(12)).strip())),
])
def test_response_sections(spark, text, want):
    assert tuple(spark.createDataFrame([(text,)], "t string").select(S.response_sections(F.col("t")).alias("s")).first().s) == want


def plain_content(text, terms):
    own, out, scored = [x.strip() for x in (text or "").splitlines() if x.strip()], [], False
    source = lambda low: low.startswith(("url:", "sources:", "http")) or "http" in low or "sources" in low
    for i, line in enumerate(own):
        low = line.lower()
        m = re.match(r"(?:esta|este|esto|esa|ese|eso|dicha|dicho|tal)\s+(\w+)", low)
        if source(low) or low.startswith("web search results for query") or len(line) < 3 or re.match(r"\*\*.+\*\*$", line) or not re.search(S.LETTER, line) or re.match(S.HEADING, line) or re.match(S.META, low) or (m and m[1] not in S.TIMES):
            continue
        if not terms:
            out.append(line)
        elif any(fold(t) in fold(line) for t in terms):
            out.append(line)
            for after in own[i + 1 : i + 3]:
                if source(after.lower()) or not re.search(S.LETTER, after):
                    break
                out.append(after)
                if {*terms} & {*S.SPORTS} and re.search(S.SCORE, after):
                    break
        elif re.search(S.SCORE, line) and not scored:
            out.append(line)
            scored = True
    return out


LINES = ["goal of Japón today", "GOAL again", "team 3 - 2 other", "1-0", "---", "url: x", "see http://x", "Sources: a", "**bold line**", "III. Analysis of", "a) Then", "esta semana goal", "esta cosa goal", "Las últimas noticias sobre goal destaca", "plain words", "ab", "", " goal ", "Web search results for query: goal", "二 goal", "—"]


@pytest.mark.parametrize("terms", [(), ("goal",), ("japon", "futbol"), ("goal", "partido")])
def test_content_lines(spark, terms):
    texts = [None, "", "goal", "goal\ngoal\ngoal\ngoal"] + ["\n".join(r.choice(LINES) for _ in range(r.randrange(14))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.content_lines(F.col("t"), terms).alias("c"))
    assert {x.i: x.c for x in df.collect()} == {i: plain_content(t, terms) for i, t in enumerate(texts)}


def test_section_lines(spark):
    texts = {
        0: None, 1: "- “Una cita larga aquí” - El País\n2. El GOBIERNO anunció  medidas\nel gobierno anuncio medidas\ncorta: x\nnothing to see in this line\nurl: governo governo\nkey: value and more", 2: "Estos titulares: gobierno\n1234567890: 12",
        3: "intro words - first bullet without any mark here 1. second bullet of the list there • short - third bullet runs on to the very end",
    }
    df = spark.createDataFrame(list(texts.items()), "i int, t string").select("i", S.section_lines(F.col("t"), ("estos titulares",)).alias("c"))
    assert {x.i: x.c for x in df.collect()} == {
        0: [], 1: ["“Una cita larga aquí” - El País", "El GOBIERNO anunció medidas", "key: value and more"], 2: [],
        3: ["first bullet without any mark here", "second bullet of the list there", "short - third bullet runs on to the very end"],
    }
