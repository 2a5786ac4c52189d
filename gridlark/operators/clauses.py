"""Contracts and ordinances by clause: articles with children, appendices, rounds of addenda and the date of a transition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.operators.chunking import windows_of
from gridlark.operators.notation import CUTS, evened

#: Where an article, a paragraph of it and an annex begin, and an article's number and title.
ARTICLE, PARAGRAPH, ANNEX = r"(?im)(?:^|\n)\s*(제\s*\d+\s*조|Article\s*\d+)", r"(?m)(?:^|\n)\s*(?:[①-⑯]|\d+\.\s)", r"(?m)(?:^|\n)\s*(별지|별표|특약|부속서|첨부)"
HEAD = r"(?i)^\s*(?:제\s*(\d+)\s*조|Article\s*(\d+))\s*[(\[（【]?([^)\]）】\n]{0,40})[)\]）】]?"
#: Fixed value: characters that the paragraphs of one child may have together.
CHILD, CHILD_OVERLAP = 400, 80
#: Parts of a long head, its title, and what stands before tables.
HEAD_SIZE, HEAD_OVERLAP, HEAD_TITLE, TABLES = 1_500, 200, "계약 정보", "\n\n[표 데이터]\n"
#: Words of each topic of a clause, of the law that governs it, of the side that it favours, and of industries in names of projects.
TOPICS = {
    "비밀유지": ("비밀", "기밀", "confidential", "disclosure", "secrecy"), "손해배상": ("손해배상", "배상", "indemnification", "indemnity", "liability", "damages"), "준거법": ("준거법", "governing law", "applicable law"),
    "분쟁해결": ("분쟁해결", "중재", "소송", "관할", "dispute resolution", "arbitration", "jurisdiction"), "IP귀속": ("지식재산", "특허", "저작권", "intellectual property", "patent", "copyright", "성과물"),
    "용역대금": ("대금", "지급", "금액", "payment", "fee", "invoice", "단가"), "검수": ("검수", "인수", "검사", "acceptance", "inspection"), "계약기간/갱신": ("기간", "갱신", "기간 만료", "유효기간", "term", "renewal", "expiration"),
    "해제/해지": ("해제", "해지", "termination", "terminate"), "불가항력": ("불가항력", "force majeure"), "권리의무양도": ("양도", "transfer", "assignment", "assign"), "하도급제한": ("하도급", "재위탁", "subcontract"),
    "하자보수": ("하자보수", "하자 담보", "하자보증", "warranty", "defect"), "이사지명권": ("이사 지명", "이사 선임", "board nominee", "appoint director"), "우선매수권": ("우선매수", "우선 매수", "right of first refusal"),
    "동반매도권": ("동반매도", "동반 매도", "tag-along", "tag along"), "강제매도권": ("강제매도", "강제 매도", "drag-along", "drag along"), "교착상태": ("교착", "deadlock"),
    "진술보장": ("진술 및 보장", "진술보장", "representations and warranties"), "경업금지": ("경업금지", "경업 금지", "non-compete", "non compete"), "선행조건": ("선행조건", "조건 선행", "conditions precedent"),
}
LAWS = {"대한민국": ("대한민국", "Korean Law", "laws of Korea", "laws of the Republic of Korea"), "영국": ("England", "영국법", "laws of England"), "뉴욕주": ("New York", "뉴욕주법", "laws of New York")}
BIASES = {"pro-buyer": ("갑의 승인", "발주자의 서면", "매수인의 동의", "sole discretion of Buyer", "written consent of Buyer"), "pro-seller": ("을은 책임을 지지", "수급인의 면책", "seller shall not be liable", "limitation of liability of Seller")}
INDUSTRIES = {"태양광": ("태양광", "solar", "염해", "증도"), "풍력": ("풍력", "wind")}
#: Kinds of documents by the way in which they are cut.
STRATEGIES = {"contract": ("contract", "epc", "ppa", "om", "pf", "equity_sale"), "report": ("report", "supervision", "permit"), "financial": ("financial",)}
#: Where a round of addenda begins, words of a transition and of power projects, and when a round takes effect.
ROUND = r"부\s*칙\s*(?:[(（<]\s*(?:조례\s*제\s*\d+\s*호\s*,\s*)?(\d{4})\s*[·.\-]\s*(\d{1,2})\s*[·.\-]\s*(\d{1,2})\s*\.?\s*[)）>])?"
TRANSITION, POWER = "경과조치", "발전사업허가|전기사업법|풍력|태양에너지|재생에너지"
AT_ONCE, AFTER_DAYS, ON_DAY = r"공포한?\s*날부터\s*시행", r"공포\s*후\s*(\d+)\s*일이?\s*지난\s*날부터\s*시행", r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일부터\s*시행"
_CUT, _PART = CUTS


def strategy(kind: Column) -> Column:
    """How documents of a kind are cut: contract, report, financial or general."""
    return F.coalesce(*[F.when(kind.isin(*kinds), F.lit(name)) for name, kinds in STRATEGIES.items()], F.lit("general"))


def _once(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def _articles(text: Column) -> Column:
    """(no, role, kind, number, title, content) of an evened text as an array; null without articles."""

    def article(content: Column, no: Column) -> Column:
        number = F.coalesce(F.nullif(F.regexp_extract(content, HEAD, 1), F.lit("")), F.nullif(F.regexp_extract(content, HEAD, 2), F.lit(""))).cast("int")
        first = no == 0
        return F.struct(
            no.alias("no"),
            F.when(first, "standalone").otherwise("parent").alias("role"),
            F.when(first, "header").when(content.rlike(ANNEX), "annex").otherwise("article").alias("kind"),
            F.when(~first, number).alias("number"),
            F.when(first, HEAD_TITLE).otherwise(F.trim(F.regexp_extract(content, HEAD, 3))).alias("title"),
            content.alias("content"),
        )

    parts = F.split(F.regexp_replace(text, ARTICLE, f"{_CUT}$0"), _CUT)
    cut = lambda ps: F.transform(ps, lambda raw, no: _once(_stripped(raw), lambda content: article(content, no)))
    return _once(parts, lambda ps: F.when(F.size(ps) > 1, F.filter(cut(ps), lambda a: a["content"] != "")))


def articles(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, role, kind, number, title, content) of each text: what stands before the first article, and every article; texts without articles have no row.

    ``number`` is null and the role ``standalone`` for the head; an article that names an annex is of kind ``annex``.
    """
    return docs.select(key, F.explode(_articles(evened(F.col(text)))).alias("_a")).select(key, "_a.*")


def _paragraphs(content: Column) -> Column:
    """The paragraphs of an evened article."""
    marked = F.regexp_replace(content, f"(?<=.){PARAGRAPH}", f"{_CUT}$0")
    return F.filter(F.transform(F.split(marked, _CUT), _stripped), lambda s: s != "")


def _unmarked(pieces: Column, size: int) -> Column:
    """The text of an article that is one paragraph of over ``size`` characters; null for others."""
    return F.when((F.size(pieces) == 1) & (F.length(F.get(pieces, F.lit(0))) > size), F.get(pieces, F.lit(0)))


def _packed(pieces: Column, size: int) -> Column:
    """Paragraphs packed in order up to ``size`` characters. Lengths are folded to the first and last of each child, so no text is copied."""
    span = "array<struct<first:int,last:int>>"
    start = F.struct(F.lit(1).alias("i"), F.lit(1).alias("first"), F.lit(0).alias("n"), F.array().cast(span).alias("cut"))

    def step(at: Column, n: Column) -> Column:
        full = (at["i"] > 1) & (at["n"] + n > size)
        done = F.array(F.struct(at["first"].alias("first"), (at["i"] - 1).alias("last")))
        return F.struct(
            (at["i"] + 1).alias("i"),
            F.when(full, at["i"]).otherwise(at["first"]).alias("first"),
            F.when(full | (at["i"] == 1), n).otherwise(at["n"] + 1 + n).alias("n"),
            F.when(full, F.concat(at["cut"], done)).otherwise(at["cut"]).alias("cut"),
        )

    def packed(held: Column) -> Column:
        folded = F.aggregate(F.transform(held, F.length), start, step, lambda at: F.concat(at["cut"], F.array(F.struct(at["first"].alias("first"), (at["i"] - 1).alias("last")))))
        return F.when(F.size(held) == 0, F.array().cast("array<string>")).otherwise(F.transform(folded, lambda c: F.array_join(F.slice(held, c["first"], c["last"] - c["first"] + 1), "\n")))

    return _once(pieces, packed)


def children(parents: DataFrame, keys: list[str], content: str, size: int = CHILD) -> DataFrame:
    """(keys, child, content): the paragraphs of each article, packed in order into children of up to ``size`` characters; a longer paragraph is one by itself.

    Every paragraph stands in exactly one child. An article's paragraphs are
    one array on its own row, made once. An article without marks of paragraphs
    is cut into overlapping windows of ``size``.
    """
    cut = parents.select(*keys, _paragraphs(evened(F.col(content))).alias("_p"))
    told = cut.select(*keys, "_p", windows_of(CHILD_OVERLAP, size)(F.array(_unmarked(F.col("_p"), size))).alias("_w"))
    return told.select(*keys, F.posexplode(F.coalesce(F.get("_w", F.lit(0)), _packed(F.col("_p"), size))).alias("child", "content"))


def clause_tags(text: Column, project: Column) -> Column:
    """(language, law, topic, bias, industry) of a clause.

    The topic is the one of which most words stand in the clause, the first of
    equals; a law that is named counts before the one that a language suggests.
    """
    low = F.lower(text)
    korean = F.regexp_count(text, F.lit("[ㄱ-ㅣ가-힣]")) / F.greatest(F.length(text), F.lit(1)) > 0.05
    some = lambda words, at: at.rlike("|".join(f"\\Q{w}\\E" for w in words))
    count = lambda words, at: sum((at.contains(w).cast("int") for w in words[1:]), at.contains(words[0]).cast("int"))
    topics = F.array(*[F.struct(count(words, low).alias("n"), F.lit(-i).alias("back"), F.lit(name).alias("name")) for i, (name, words) in enumerate(TOPICS.items())])
    best = F.array_max(topics)
    law = F.coalesce(*[F.when(some(words, text), F.lit(name)) for name, words in LAWS.items()], F.when(korean, "대한민국").otherwise("뉴욕주 (추정)"))
    sides = [count(words, text) for words in BIASES.values()]
    bias = F.when(sides[0] > sides[1], list(BIASES)[0]).when(sides[1] > sides[0], list(BIASES)[1]).otherwise("neutral")
    industry = F.coalesce(*[F.when(some(words, F.lower(F.coalesce(project, F.lit("")))), F.lit(name)) for name, words in INDUSTRIES.items()], F.lit("일반"))
    return F.struct(
        F.when(korean, "ko").otherwise("en").alias("language"), law.alias("law"), F.when(best["n"] > 0, best["name"]).otherwise("기타").alias("topic"), bias.alias("bias"), industry.alias("industry")
    )


def contract_chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, child, role, kind, number, title, content) of each text in reading order; ``child`` is null for all but the children of articles.

    What stands before the first article is cut into parts of ``HEAD`` characters
    that overlap; tables after ``TABLES`` are passages of their own; a text
    without articles and tables is cut into general windows. A null text has none.
    A text's passages are one array on its own row, in their order, so texts are
    read once and none is shuffled.
    """
    none, mark = F.lit(None).cast("int"), TABLES.strip()
    kept = "array<struct<child:int,role:string,kind:string,number:int,title:string,content:string>>"

    def passage(content: Column, role, kind, number: Column = none, title=HEAD_TITLE, child: Column = none) -> Column:
        as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(child.cast("int").alias("child"), as_column(role).alias("role"), as_column(kind).alias("kind"), number.alias("number"), as_column(title).alias("title"), content.alias("content"))

    at = F.instr("_t", TABLES)
    rows = docs.select(F.col(key).alias("key"), evened(F.col(text)).alias("_t"))
    rows = rows.select("key", F.when(at > 0, F.left("_t", at - 1)).otherwise(F.col("_t")).alias("body"), F.when(at > 0, F.substring("_t", at + 2, F.length("_t"))).alias("tables"))
    rows = rows.select("key", "body", "tables", _articles(F.col("body")).alias("found"))
    parents = F.coalesce(F.transform(F.filter("found", lambda a: a["role"] == "parent"), lambda a: F.struct(a.alias("a"), _paragraphs(a["content"]).alias("p"))), F.array())
    head = F.when(F.col("found").isNotNull(), F.get(F.transform(F.filter("found", lambda a: a["role"] == "standalone"), lambda a: a["content"]), F.lit(0))).when(F.col("tables").isNotNull(), F.nullif(_stripped(F.col("body")), F.lit("")))
    plain = F.when(F.col("found").isNull() & F.col("tables").isNull() & F.col("key").isNotNull(), F.col("body"))
    rows = rows.select("key", head.alias("head"), parents.alias("parents"), "tables", plain.alias("plain"))
    rows = rows.select("key", "head", "parents", "tables", windows_of(CHILD_OVERLAP, CHILD)(F.transform("parents", lambda x: _unmarked(x["p"], CHILD))).alias("cut"), F.get(windows_of()(F.array("plain")), F.lit(0)).alias("windows"))

    begins = F.when(F.length("head") > HEAD_SIZE, F.sequence(F.lit(0), F.length("head") - 1, F.lit(HEAD_SIZE - HEAD_OVERLAP))).otherwise(F.array(F.lit(0)))
    parts = F.filter(F.transform(begins, lambda i: _stripped(F.substring(F.col("head"), i + 1, F.lit(HEAD_SIZE)))), lambda c: c != "")
    heads = F.when(F.col("head").isNotNull(), F.transform(parts, lambda c: passage(c, "standalone", "header")))

    def article(x: Column, i: Column) -> Column:
        a, kids = x["a"], F.coalesce(F.get("cut", i), _packed(x["p"], CHILD))
        return F.concat(F.array(passage(a["content"], "parent", a["kind"], a["number"], a["title"])), F.transform(kids, lambda c, n: passage(c, "child", a["kind"], a["number"], a["title"], n)))

    blocks = F.filter(F.transform(F.split("tables", r"\n\s*\n"), _stripped), lambda b: (b != "") & (b != mark))
    tables = F.transform(blocks, lambda b: passage(F.when(b.startswith(mark), b).otherwise(F.concat(F.lit(mark + "\n"), b)), "standalone", "table", title="별첨 데이터"))
    titled = lambda first: F.when(F.length(first) < 50, F.left(first, F.lit(40))).otherwise("")
    general = F.transform("windows", lambda c: passage(c, "standalone", "general", title=_once(F.trim(F.regexp_extract(c, r"^([^\n]*)", 1)), titled)))
    every = F.concat(*[F.coalesce(p.cast(kept), F.array().cast(kept)) for p in (heads, F.flatten(F.transform("parents", article)), tables, general)])
    return rows.select(F.col("key").alias(key), F.posexplode(every).alias("no", "_x")).select(key, "no", "_x.*")


def appendix(label: Column) -> Column:
    """(number, branch) of an appendix label; empty where none is named."""
    pattern = r"별\s*표\s*(\d+)(?:\s*의\s*(\d+))?"
    return F.struct(F.regexp_extract(F.coalesce(label, F.lit("")), pattern, 1).alias("number"), F.regexp_extract(F.coalesce(label, F.lit("")), pattern, 2).alias("branch"))


def addenda(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, promulgated, text): the rounds of addenda of a text in order, each with its date (YYYYMMDD, empty if it names none); a text without rounds is one."""
    blob = _stripped(F.regexp_replace(evened(F.col(text)), r"\s+", " "))
    marked = F.regexp_replace(blob, ROUND, f"{_CUT}$1|$2|$3{_CUT}")
    parts = F.split(marked, _CUT)
    pair = lambda i: F.struct(F.split(F.get("_p", i), r"\|").alias("d"), _stripped(F.get("_p", i + 1)).alias("text"))
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_p") - 2, F.lit(1)), F.lit(2)), pair), lambda x: F.coalesce(x["text"], F.lit("")) != "")
    rows = docs.select(key, parts.alias("_p"), blob.alias("_b")).where("_b <> ''").withColumn("_x", F.when(F.size("_p") >= 3, pairs))
    some = rows.select(key, F.posexplode(F.when(F.size(F.coalesce("_x", F.array())) > 0, F.col("_x")).otherwise(F.array(F.struct(F.array(F.lit("")).alias("d"), F.col("_b").alias("text"))))).alias("no", "_y"))
    d = F.col("_y.d")
    date = F.when(F.get(d, F.lit(0)) == "", "").otherwise(F.concat(F.get(d, F.lit(0)), F.lpad(F.get(d, F.lit(1)), 2, "0"), F.lpad(F.get(d, F.lit(2)), 2, "0")))
    return some.select(key, "no", date.alias("promulgated"), F.col("_y.text").alias("text"))


def transition(rounds: DataFrame, key: str) -> DataFrame:
    """(key, date, basis): when the last round with a transition for power projects takes effect, and how that is known.

    A day that is written there counts first, then days after promulgation,
    then the promulgation itself (at once, or for want of anything better).
    """
    about = rounds.where(F.col("text").contains(TRANSITION) & F.col("text").rlike(POWER))
    last = about.groupBy(key).agg(F.max_by(F.struct("promulgated", "text"), "no").alias("r"))
    text, pub = F.col("r.text"), F.col("r.promulgated")
    part = lambda g: F.regexp_extract(text, ON_DAY, g)
    day = F.concat(part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    later = F.date_format(F.date_add(F.try_to_date(pub, "yyyyMMdd"), F.regexp_extract(text, AFTER_DAYS, 1).try_cast("int")), "yyyyMMdd")
    dated = pub.rlike("^[0-9]{8}$")
    return last.select(
        key,
        F.when(text.rlike(ON_DAY), day).when(dated & text.rlike(AFTER_DAYS), later).when(dated, pub).otherwise("").alias("date"),
        F.when(text.rlike(ON_DAY), "EXPLICIT").when(dated & text.rlike(AFTER_DAYS), "AFTER_DAYS").when(dated & text.rlike(AT_ONCE), "IMMEDIATE").otherwise("PROMULGATED").alias("basis"),
    )


def earlier_permits(slices: DataFrame, rules: DataFrame, region: str, order: list[str]) -> DataFrame:
    """(region, cutoff, by_transition, earlier): each region's first dated rule (effective, transition), and whether its permit (permit) is older than that.

    Regions without a dated rule have no row; without a permit ``earlier`` is false.
    """
    cutoff = F.coalesce("transition", "effective")
    dated = rules.where(cutoff.isNotNull()).groupBy(region).agg(F.min_by(F.struct(cutoff.alias("cutoff"), F.col("transition").isNotNull().alias("by_transition")), F.struct(*order)).alias("r"))
    return slices.join(dated, region).select(region, "r.cutoff", "r.by_transition", F.coalesce(F.col("permit") < F.col("r.cutoff"), F.lit(False)).alias("earlier"))
