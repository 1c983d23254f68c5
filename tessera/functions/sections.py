"""Sections and lines of a text: headings, answers in parts, lines of content, as column expressions over one row's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as X

#: Headings of the two kinds of section that are kept, and of the sections that end them.
KINDS = {
    "candidate_expectations": (
        r"requirements?", r"qualifications?", r"required qualifications?", r"minimum qualifications?", r"required skills?(?: and experience)?", r"what you(?:'|’)ll need(?: to succeed)?", r"what you need to succeed",
        r"what we need to see", r"who you are", r"who are we looking for\??", r"we are looking for", r"what you bring", "応募資格", "必須要件", "歓迎要件", "求める人物像", "必要な経験", "자격요건", "지원자격", "필수요건", "우대사항",
    ),
    "responsibilities": (
        r"responsibilities", r"key responsibilities", r"role responsibilities", r"duties(?: and responsibilities)?", r"tasks", r"what you(?:'|’)ll do", r"what you will do", r"what you(?:'|’)ll be doing",
        r"in this role,? you(?:'|’)ll get to", r"in this role", "業務内容", "仕事内容", "従事すべき業務の内容", "担当業務", "담당업무", "주요업무", "주요 업무",
    ),
}
OTHER = (
    "about(?: us| the role)?", "about .+", "benefits?", "preferred qualifications?", "nice to have", r"ways to stand out(?: from the crowd)?", "company", "company information", "compensation(?: & benefits)?", "salary", "location",
    "working conditions?", "work hours?", "holidays?(?: and leave)?", "probation period", "insurance", "additional information", "discover more.*", "equal opportunity employer", "disclaimer", "job type",
    "待遇", "福利厚生", "会社概要", "勤務地", "勤務時間", "休日", "給与", "雇用形態", "회사소개", "혜택", "복리후생",
)
SIGNS, BRACKETS = r"^[#>*•●▪◦\-\s]+", "[](){}【】「」『』〈〉《》"
#: Lines that hold no content, by beginning, by part and by pattern; words after "this" that only tell a time.
BEGINNINGS, PARTS = ("url:", "sources:", "http"), ("http", "sources")
HEADING = r"^(?:[IVXLC]+\.|[A-Z]\.|[1-9]\d?\.|[a-z]\))\s+[A-ZÁÉÍÓÚ]"
META = r"^(?:la informaci[oó]n|las [uú]ltimas noticias|los [uú]ltimos datos|el [uú]ltimo informe).{0,60}(?:destaca|indican?|se[nñ]alan?|muestra|revela|se centra|aborda|trata)"
THIS = r"(?U)^(?:esta|este|esto|esa|ese|eso|dicha|dicho|tal)\s+(\w+)"
TIMES = ("semana", "año", "mes", "dia", "día", "lunes", "martes", "miércoles", "miercoles", "jueves", "viernes", "sabado", "sábado", "domingo", "mañana", "noche", "tarde", "trimestre", "periodo", "período")
LETTER, SCORE = "[A-Za-zÁÉÍÓÚÑáéíóúñ0-9]", r"\b\d+\s*-\s*\d+\b"
SPORTS = ("futbol", "football", "soccer", "resultado", "resultados", "partido", "partidos", "marcador")
#: Stems of words of which one makes a line news, in Italian and Spanish.
STEMS = (
    "accoltell", "omicid", "arrest", "morti", "morto", "uccis", "esplos", "condann", "indagat", "rapin", "furto", "blitz", "nas", "polizia", "carabini", "droga", "sparator", "violenza", "tribunal", "decreto", "parlament", "governo",
    "detenid", "arrestad", "operativo", "homicidio", "asesin", "robo", "hurto", "narco", "policial", "fiscal", "juzgado", "imputad", "sentencia", "condena", "presidio", "carcel", "prision", "ministro", "presidente", "congreso", "senado",
    "partido", "eleccion", "gobierno", "presupuesto", "inflacion", "mercado", "empresa", "bolsa",
)


def lines(text: Column) -> Column:
    """The lines of a text, by any line end; null counts as empty, which has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]")


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def full_lines(text: Column) -> Column:
    """The lines that aren't blank, trimmed."""
    return F.filter(F.transform(lines(text), stripped), lambda line: line != "")


def _any(x: Column, parts: tuple[str, ...], how=F.contains) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | how(x, F.lit(p))
    return out


def clean_heading(line: Column) -> Column:
    bare = stripped(F.regexp_replace(line, SIGNS, ""))
    return X.collapsed(F.trim(bare, F.lit(BRACKETS)))


def headed_sections(text: Column, kinds: dict[str, tuple[str, ...]] | None = None, other: tuple[str, ...] = OTHER, most: int = 6, length: int = 180) -> Column:
    """For each kind an array of the first ``most`` distinct items under its headings.

    A line that begins with a heading opens its kind, and what follows the heading is the first item; a line that is a heading of
    ``other`` closes it; other lines are items of the kind that is open. Items lose bullet signs and numbers, addresses are
    redacted, and they are cut at a word to ``length``; items that differ by case only are one. The state
    that goes from line to line is the open kind and the items so far, so it stays small however long the text.
    """
    kinds = KINDS if kinds is None else kinds
    ends = rf"(?iu)^(?:{'|'.join(other)})\s*:?\s*$"

    tests = {k: rf"(?iu)^(?:{'|'.join(p)})\s*:?\s*(.*)$" for k, p in kinds.items()}

    def marked(line: Column) -> Column:
        head, kind, raw = line["head"], F.when(line["bare"].rlike(ends), ""), line["line"]
        for k in reversed(list(kinds)):
            kind, raw = F.when(head.rlike(tests[k]), k).otherwise(kind), F.when(head.rlike(tests[k]), F.regexp_extract(head, tests[k], 1)).otherwise(raw)
        return F.struct(kind.alias("kind"), F.regexp_replace(F.regexp_replace(raw, SIGNS, ""), r"^\s*\d+[.)]\s+", "").alias("raw"))

    # a step for each value that later steps use more than once, so that each is made once a line
    rows = F.transform(lines(text), lambda line: F.struct(line.alias("line"), clean_heading(line).alias("head"), stripped(line).alias("bare")))
    rows = F.transform(F.transform(rows, marked), lambda r: F.struct(r["kind"].alias("kind"), X.redacted(r["raw"], length * 3).alias("raw")))
    rows = F.transform(rows, lambda r: F.struct(r["kind"].alias("kind"), F.when(r["kind"].eqNullSafe(""), "").otherwise(X.cut_at_word(r["raw"], length)).alias("item")))

    def step(state: Column, row: Column) -> Column:
        kind = F.coalesce(row["kind"], state["open"])
        full = F.size(F.filter(state["items"], lambda i: i["kind"] == kind)) >= most
        known = F.exists(state["items"], lambda i: (i["kind"] == kind) & (F.lower(i["item"]) == F.lower(row["item"])))
        new = F.array(F.struct(kind.alias("kind"), row["item"].alias("item")))
        return F.struct(kind.alias("open"), F.when((kind == "") | (row["item"] == "") | full | known, state["items"]).otherwise(F.concat(state["items"], new)).alias("items"))

    empty = F.struct(F.lit("").alias("open"), F.array().cast("array<struct<kind:string,item:string>>").alias("items"))
    found = F.aggregate(rows, empty, step, lambda s: s["items"])

    def of(kind: str) -> Column:
        return F.transform(F.filter(found, lambda i: i["kind"] == kind), lambda i: i["item"])

    return F.struct(*(of(k).alias(k) for k in kinds))


def response_sections(text: Column) -> Column:
    """reasoning, conclusion, final of an answer.

    If all three words occur, lines of one of them alone, with or without colons, open its part; lines before the first belong to none, blank ones are left out.
    Else the reasoning lists the distinct titles of links, eight at most, each with its host, and the final part is what stands before a
    line ``Sources:``, or all if nothing does; without links the whole text is final.
    """
    whole = stripped(F.coalesce(text, F.lit("")))
    head = r"(?im)^[^\S\n]*(reasoning|conclusion|final response):*[^\S\n]*$"
    one = F.array_join(lines(whole), "\n")
    parts = F.split(one, head)
    keys = F.transform(F.regexp_extract_all(one, F.lit(head), 1), F.lower)

    def part(key: str) -> Column:
        own = F.filter(F.transform(keys, lambda k, i: F.when(k == key, F.get(parts, i + 1))), lambda p: p.isNotNull())
        kept = F.filter(F.split(F.array_join(own, "\n"), "\n"), lambda line: stripped(line) != "")
        return stripped(F.array_join(F.transform(kept, lambda line: F.regexp_replace(line, r"(?U)\s+$", "")), "\n"))

    link = r"\[([^\]]+)\]\((https?://[^)]+)\)"
    pairs = F.arrays_zip(F.regexp_extract_all(whole, F.lit(link), 1).alias("title"), F.regexp_extract_all(whole, F.lit(link), 2).alias("url"))
    host = lambda u: F.regexp_extract(F.lower(u), r"^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    labels = F.array_distinct(F.transform(pairs, lambda p: F.concat(stripped(p["title"]), F.lit(" ("), F.coalesce(F.nullif(host(p["url"]), F.lit("")), p["url"]), F.lit(")"))))
    listed = F.concat(F.lit("Leyendo estas fuentes y extrayendo lo relevante:\n"), F.array_join(F.transform(F.slice(labels, 1, 8), lambda t: F.concat(F.lit("- "), t)), "\n"))
    body = stripped(F.get(F.split(whole, r"(?i)\n\s*Sources\s*:\s*\n", 2), F.lit(0)))
    low = F.lower(whole)
    marked = F.contains(low, F.lit("reasoning")) & F.contains(low, F.lit("conclusion")) & F.contains(low, F.lit("final response"))
    linked = F.size(labels) > 0
    return F.struct(
        F.when(marked, part("reasoning")).when(linked, listed).otherwise("").alias("reasoning"), F.when(marked, part("conclusion")).otherwise("").alias("conclusion"),
        F.when(marked, part("final response")).when(linked, F.coalesce(F.nullif(body, F.lit("")), whole)).otherwise(whole).alias("final"),
    )


def _names_source(low: Column) -> Column:
    return _any(low, BEGINNINGS, F.startswith) | _any(low, PARTS)


def content_lines(text: Column, terms: tuple[str, ...] = ()) -> Column:
    """The lines of content that tell of ``terms``, each with up to two lines after it; without terms all lines of content.

    A line is admitted if it has a term and no rule leaves it out. The two lines after it follow unless one names a source or has no letter or
    digit, which ends it; with terms of sports, a line with a score is the last to follow. Lines that several admitted ones
    bring along are repeated. The first other line with a score is admitted too, alone.
    """
    low = F.lower
    following = lambda line: F.coalesce(~_names_source(low(line)) & line.rlike(LETTER), F.lit(False))
    word = lambda line: F.regexp_extract(low(line), THIS, 1)

    def content(line: Column) -> Column:
        out = _names_source(low(line)) | low(line).startswith("web search results for query") | (F.length(line) < 3) | line.rlike(r"^\*\*.+\*\*$") | ~line.rlike(LETTER)
        return ~(out | line.rlike(HEADING) | low(line).rlike(META) | ((word(line) != "") & ~word(line).isin(*TIMES)))

    own = full_lines(text)
    if not terms:
        return F.filter(own, content)
    wanted = F.array(*(X.folded(F.lit(t)) for t in terms))
    hit = lambda line: F.exists(wanted, lambda t: F.contains(X.folded(line), t))
    rows = F.transform(own, lambda line: F.struct(line.alias("l"), content(line).alias("ok"), hit(line).alias("hit"), line.rlike(SCORE).alias("score"), following(line).alias("follows")))
    first = F.array_position(F.transform(rows, lambda r: r["ok"] & ~r["hit"] & r["score"]), True)
    sports = bool(set(terms) & set(SPORTS))

    def admitted(r: Column, i: Column) -> Column:
        one, two = F.get(rows, i + 1), F.get(rows, i + 2)
        no = lambda x: ~F.coalesce(x["follows"], F.lit(False))
        ends = no(two) | (one["score"] if sports else F.lit(False))
        run = F.when(no(one), F.array(r["l"])).when(ends, F.array(r["l"], one["l"])).otherwise(F.array(r["l"], one["l"], two["l"]))
        none = F.array().cast("array<string>")
        return F.when(~r["ok"], none).when(r["hit"], run).when(i + 1 == first, F.array(r["l"])).otherwise(none)

    return F.flatten(F.transform(rows, admitted))


def section_lines(text: Column, drop: tuple[str, ...] = ()) -> Column:
    """The distinct lines of a page's section that read as news: quoted, with a word of STEMS, or with a quotation mark or colon.

    Lines lose bullet signs and numbers; those under twelve characters, without letters, that name sources, or whose folded text has one of ``drop``
    are left out. If no line is admitted, the bullets of the text, written on one line, are.
    """
    def usable(clean: Column) -> Column:
        return ~_any(X.folded(clean), drop) if drop else F.lit(True)

    own = full_lines(text)
    rows = F.transform(own, lambda line: F.struct(X.folded(line).alias("low"), X.collapsed(F.regexp_replace(line, r"^\s*(?:[-*•]\s+|\d+\.\s+)", "")).alias("clean")))
    bad = lambda low: _any(low, (*BEGINNINGS, "<<<cite_this:", "error al procesar la pagina web"), F.startswith) | F.contains(low, F.lit("<<<cite_this:"))
    rows = F.filter(rows, lambda r: ~bad(r["low"]) & (F.length(r["clean"]) >= 12) & r["clean"].rlike("[A-Za-zÁÉÍÓÚÑáéíóúñ]") & usable(r["clean"]))
    stems = rf"(?U)\b(?:{'|'.join(STEMS)})\w*\b"
    quoted = lambda c: c.rlike('^["“].+["”]$') | c.rlike(r'^["“].+["”]\s*[-:]\s*.+$')
    news = F.transform(F.filter(rows, lambda r: quoted(r["clean"]) | r["low"].rlike(stems) | F.contains(r["clean"], F.lit('"')) | F.contains(r["clean"], F.lit(":"))), lambda r: r["clean"])
    bullets = F.regexp_extract_all(F.array_join(own, " "), F.lit(r"(?:^|\s)(?:[-*•]|\d+\.)\s+([^-\n].{12,220}?)(?=(?:\s(?:[-*•]|\d+\.)\s+)|$)"), 1)
    other = F.filter(F.transform(bullets, stripped), lambda b: (b != "") & usable(b))
    chosen = F.when(F.size(news) > 0, news).otherwise(other)
    keys = F.transform(chosen, lambda c: X.folded(c))
    return F.filter(F.transform(chosen, lambda c, i: F.when(F.array_position(keys, F.get(keys, i)) == i + 1, c)), lambda c: c.isNotNull())
