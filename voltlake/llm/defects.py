"""Problem 3: question-answer pairs with a defective answer.

Each pair gets at most one defect, the first of: empty, copied, refusal, other_language, truncated.

copied: shingles of three letters of question and answer are aligned. Where they share most, the longest common
subsequence (of the answer and of the answer turned round at its best place) tells how much of the answer is not the question; the
answer is a copy if next to nothing else is left and most of the question is there.
refusal: each sentence of the answer is aligned with the refusal templates by its longest common subsequence of tokens, slots
being free. An answer is a refusal if every sentence is a refusal, an opening or a closing, and one is a refusal.
other_language: script counts and function words give the language of question and answer.
truncated: open brackets, blocks, bullets and tables, an end inside a sentence, fewer points than announced.

Defined cases: null and blank answers are empty; a blank question has neither copies nor other languages; repeated rows count
once; rows without an id give no row; of several states of a chat the current one counts; whole texts are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.functions.content import has_content, is_completed

# Refusal sentences, * stands for any words.
TEMPLATES = """
缺少依据，暂不作判断
您问的内容不在知识库收录之列
目前掌握的信息还不足以支持回答
检索到的内容与提问无关，故不作答
我不能提供这方面的操作指导
没有可引用的段落，回答只能到此为止
关于*，资料中未见说明，恕难答复
这方面我帮不上忙，建议直接联系设备厂家
该问题已触及涉密范围，恕不展开
出于安全考虑，这类问题我不予回复
这类判断须由持证人员作出，我不便代劳
我手头的材料里查不到*的相关内容
这个问题超出了我能回答的范围
手册里没有这一项，我不想凭空猜测
我暂时回答不了，请换一个问题
材料前后矛盾，我无从给出答复
作为知识助手，我没有权限讨论*的运行情况
所给条款只谈*，没有说到*，因此不能作答
*的数据我看不到，给不了结论
查遍所附章节，未见与*相符的论述，我选择不回答
现有资料没有涉及*的这一情况，不便给出结论
无法从现有资料中确定该参数
资料不足，无法回答
信息不足，无法判断
我无法回答这个问题
我不能回答该问题
there is too little information to reply
I must pass on this one
this lies outside what I may discuss
I can't give guidance on such work
the passages contradict each other and I leave the question open
the material at hand says nothing about *
only licensed staff may judge this, so I decline
the retrieved passages deal with * only, so I will not guess
answering this is beyond my remit
I would rather not answer without evidence
no paragraph can be quoted for this, hence no reply
I have no view of the data of *
I am not able to help with this request
nothing in the sources covers *
I cannot answer this question
I am unable to answer that
Die Unterlagen enthalten keine Angaben zu *, daher keine Antwort
Diese Anfrage darf ich nicht bearbeiten
Dazu kann ich leider nichts sagen
Diese Frage kann ich nicht beantworten
Les documents ne disent rien sur *, je préfère m'abstenir
Désolé, cela dépasse mon domaine
Je ne peux pas répondre à cette question
""".strip().splitlines()
# Words that open or close a refusal.
OPENINGS = r"^(?:抱歉|对不起|不好意思|很遗憾|非常抱歉|您好|你好|谢谢提问|感谢提问|I'm sorry|I am sorry|Sorry|Apologies|Unfortunately|Regrettably|Thank you for asking|Leider|Entschuldigung|Désolée?|Malheureusement)(?:[，,：:；;！!]\s*|\s+)(?:(?:but|however|aber|mais)[,，]?\s+)?"
CLOSINGS = r"^(?:请谅解|请补充资料后再提问|建议另行查证|若能提供.{1,14}，我再尝试分析|如有新的依据可以再问|feel free to rephrase|please consult a qualified engineer|please add documents and ask again|try the maker instead|抱歉|对不起|不好意思|很遗憾|您好|sorry|apologies|bitte .{3,60}|merci de .{3,60}|veuillez .{3,60})$"
CUE = re.compile(
    r"[不没无未恕暂缺难]|超出|足以|涉密|矛盾|\b(?:not|no|n't|nothing|cannot|can't|unable|decline|pass|beyond|outside|little|rather|only|contradict\w*|nicht|nichts|keine?|pas|rien|dépasse|abstenir|data)\b", re.I
)
STRONG = re.compile(
    r"(?:无法|不能|难以|无从|不便|没有权限|恕难|恕不|不予|拒绝|暂不|无权)[^，。]{0,8}(?:回答|作答|答复|回复|讨论|代劳|展开|给出结论)|(?:不作答|不回答|帮不上忙|回答不了|给不了结论)|"
    r"\bI (?:can ?not|can't|am (?:not able|unable) to|won't|will not|must decline|decline to) (?:answer|help|reply|respond|assist|discuss|comment)|ich (?:kann|darf) .{0,30}nicht (?:beantworten|bearbeiten)|je ne (?:peux|puis) pas répondre",
    re.I,
)
# Frequent function words.
FUNCTION_WORDS = {
    "en": "the of and is are for with to at if from that by on as this be which has was what how does after more before when can".split(),
    "de": "der die das und ist bei mit nicht nach den im wird dem ein eine auf für von als zu sich auch länger wenn was des".split(),
    "fr": "le la les de des du et est pour dans un une si par plus que pas au il faut aux sur avec après avant quels que l d".split(),
}
_WORD_OF = {w: lang for lang, words in FUNCTION_WORDS.items() for w in words}
_ASKED = {
    "zh": r"中文|汉语|chinese|chinesisch|chinois",
    "en": r"英文|英语|english|englisch|anglais",
    "de": r"德文|德语|german|deutsch|allemand",
    "fr": r"法文|法语|french|französisch|français",
}
_ASKS = re.compile(r"用|以|译|作答|回答|答复|回复|写|answer|reply|respond|write|translate|antwort|schreib|übersetz|répon|tradui|\bin\b|\bauf\b|\ben\b", re.I)


_HAN = re.compile(r"[㐀-鿿]+")
_WORDS = re.compile(r"[^\W\d_]{2,}")


def language(text: str) -> str | None:
    """zh, en, de, fr, or None if there's too little to tell."""
    han = sum(map(len, _HAN.findall(text)))
    if han > 0.6 * len(text):
        return "zh" if han >= 4 else None
    rest = _HAN.sub(" ", text)
    words = _WORDS.findall(rest)
    words = [w.lower() for w in words if not (w.isupper() and len(w) > 1)]
    if han >= 4 and han >= 1.5 * len(words):
        return "zh"
    if len(words) < 4:
        return None
    n = {"en": 0, "de": 0, "fr": 0}
    for w in words:
        if lang := _WORD_OF.get(w):
            n[lang] += 1
    best = max(n, key=n.get)
    return best if n[best] >= 2 and n[best] >= 0.08 * len(words) else None


def asked_for(question: str, lang: str) -> bool:
    """The question asks for an answer in this language."""
    for m in re.finditer(_ASKED[lang], question, re.I):
        if _ASKS.search(question[max(0, m.start() - 14) : m.end() + 8]):
            return True
    return False


def letters(text: str) -> str:
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", text).lower())


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    v = mask = (1 << len(a)) - 1
    for x in b:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & mask
    return len(a) - v.bit_count()


def is_copy(question: str, answer: str) -> bool:
    q = letters(question)
    if len(q) < 6:  # too short for shingles: the question itself, once or several times, or turned round
        a = letters(answer)
        return len(q) >= 2 and a != "" and (a.replace(q, "") == "" or (len(a) == len(q) and a in q + q))
    if len(answer) > 3 * len(question) + 160:  # a start that is no repetition rules out the whole
        a, most = letters(answer[: 2 * len(question) + 150])[:-4], max(24, 0.3 * len(q))
        if len(a) > len(q) + most:
            covered, qs = bytearray(len(a)), {q[i : i + 3] for i in range(len(q) - 2)}
            for i in range(len(a) - 2):
                if a[i : i + 3] in qs:
                    covered[i : i + 3] = b"\1\1\1"
            if len(a) - 2 - sum(covered[:-2]) > most:
                return False
    a = letters(answer)
    if len(a) < 4:
        return False
    qs, grams = {q[i : i + 3] for i in range(len(q) - 2)}, [a[i : i + 3] for i in range(len(a) - 2)]
    if len(qs.intersection(grams)) < 0.5 * len(qs):
        return False
    shared = [g in qs for g in grams]
    if sum(shared) < 0.5 * len(grams):
        return False
    filler = max(10, 0.25 * len(q)) if re.search(r"[㐀-鿿]", a) else max(24, 0.3 * len(q))
    if len(a) > len(q) + filler:  # the question more than once
        covered = bytearray(len(a))
        for i, s in enumerate(shared):
            if s:
                covered[i : i + 3] = b"\1\1\1"
        return len(a) - sum(covered) <= filler
    turns = {a}
    k = q.find(a[:4])
    if k > 0:
        turns.add(a[len(q) - k :] + a[: len(q) - k])
    k = a.find(q[:4])
    if k > 0:
        turns.add(a[k:] + a[:k])
    if _parts_of(q, a, shared, filler):
        return True
    best = max(common(q, t) for t in turns)
    return best >= 0.72 * len(q) and len(a) - best <= filler


def _parts_of(q: str, a: str, shared: list[bool], filler: float) -> bool:
    """The answer is the question's parts in another order, turned at any number of places: shingles cover nearly all of both."""
    covered, back, grams = bytearray(len(a)), bytearray(len(q)), {a[i : i + 3] for i in range(len(a) - 2)}
    for i, s in enumerate(shared):
        if s:
            covered[i : i + 3] = b"\1\1\1"
    for i in range(len(q) - 2):
        if q[i : i + 3] in grams:
            back[i : i + 3] = b"\1\1\1"
    return len(a) - sum(covered) <= filler and sum(back) >= 0.85 * len(q)


def _tokens(text: str) -> list[str]:
    return re.findall(r"[㐀-鿿]|[^\W_㐀-鿿]+|\*", text.lower().replace("’", "'").replace("'", ""))


def _lcs(a: list[str], b: list[str]) -> int:
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    v = mask = (1 << len(a)) - 1
    for x in b:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & mask
    return len(a) - v.bit_count()


def _beside(line: list[str], s: list[str], missing: int) -> int:
    """The least number of tokens of s outside the slots (*) of the template, if it may lack `missing` of its own; len(s) + 1 if there is no such alignment."""
    far = len(s) + 1

    def onward(row):  # to the next element of the template without a token: a slot ends, or an element is missing
        for i, x in enumerate(line):
            for m in range(missing + 1):
                to = m + (x != "*")
                if to <= missing and row[i][m] < row[i + 1][to]:
                    row[i + 1][to] = row[i][m]
        return row

    row = onward([[0 if i == m == 0 else far for m in range(missing + 1)] for i in range(len(line) + 1)])
    for w in s:
        new = [[x + (i == len(line) or line[i] != "*") for x in row[i]] for i in range(len(line) + 1)]
        for i, x in enumerate(line):
            if x == w and x != "*":
                new[i + 1] = [min(a, b) for a, b in zip(new[i + 1], row[i])]
        row = onward(new)
    return min(row[-1])


_TEMPLATE_TOKENS = [(t, "*" in line, set(t), _tokens(line)) for line in TEMPLATES for t in [[x for x in _tokens(line) if x != "*"]]]


_SENTENCE_END = re.compile(r"[。！!？?\n]+|\.(?=\s|$)|;\s+(?=feel)|，(?=请谅解)")
_OPENING, _CLOSING = re.compile(OPENINGS, re.I), re.compile(CLOSINGS, re.I)


def refuses(sentence: str) -> bool:
    """The sentence follows a refusal template (nine tenths of its tokens, in order, little beside them) or refuses outright."""
    if not CUE.search(sentence):
        return False
    s = _tokens(sentence)
    have = set(s)
    for t, slot, kinds, line in _TEMPLATE_TOKENS:
        if len(kinds & have) < 0.8 * len(kinds) or (not slot and len(s) > len(t) + 4):
            continue
        if _lcs(t, s) >= 0.86 * len(t) and (len(s) <= len(t) + 24 or _beside(line, s, int(0.14 * len(t))) <= 24):
            return True
    return bool(STRONG.search(sentence))


def is_refusal(answer: str) -> bool:
    text = answer.strip().strip("\"'“”「」*_>` ")
    found = False
    for s in _SENTENCE_END.split(text):
        s = s.strip(" \t　,，；;.*_\"'“”")
        while (short := _OPENING.sub("", s)) != s:
            s = short
        if not s or _CLOSING.match(s):
            continue
        if not refuses(s):
            return False
        found = True
    return found


_NUMBER = {w: n for n, ws in {2: "两 二 two zwei deux", 3: "三 three drei trois", 4: "四 four vier quatre", 5: "五 five fünf cinq", 6: "六 six sechs", 7: "七 seven sieben sept", 8: "八 eight acht huit", 9: "九 nine neun neuf", 10: "十 ten zehn dix"}.items() for w in ws.split()}
_ANNOUNCED = re.compile(
    r"(?:分|有|以下|共|如下|列出|把握|归纳为|包括)\s*(\d{1,2}|[两二三四五六七八九十])\s*(?:大|个|项|条|点|步|种|类|方面|部分|步骤|要点|原因|措施|环节)[^。\n:：]{0,10}[:：]|"
    r"\b(\d{1,2}|two|three|four|five|six|seven|eight|nine|ten|zwei|drei|vier|fünf|sechs|sieben|acht|neun|zehn|deux|trois|quatre|cinq|sept|huit|neuf|dix)\s+(?:\w+\s+)?(?:steps?|points?|parts?|items?|reasons?|causes?|measures?|punkte|schritte|teile|gründe|étapes?|raisons?|parties)\b[^.\n:：]{0,24}\s?[:：]",
    re.I,
)
_ITEM = re.compile(r"^[ \t]*(?:[-*+•·]|\(?\d{1,2}[.、)）．]|[（(]\d{1,2}[)）]|[①-⑳]|[一二三四五六七八九十]{1,3}、|第[一二三四五六七八九十\d]{1,3}[，,、：:步])[ \t]*(?=\S)", re.M)
_PAIRS = (("(", ")"), ("（", "）"), ("[", "]"), ("【", "】"), ("{", "}"), ("《", "》"), ("「", "」"), ("『", "』"), ("“", "”"), ("«", "»"), ("〔", "〕"))


def is_truncated(answer: str) -> bool:
    t = answer.rstrip()
    if not t:
        return False
    if t.count("```") % 2 or t.count("$$") % 2 or t.count("**") % 2 or t.count('"') % 2:
        return True
    opened = [(o, c) for o, c in _PAIRS if t.count(o) > t.count(c) or (o in "(（" and o in t)]
    if opened:
        bare = re.sub(r"(?m)^[ \t]*\(?\d{1,2}[)）]|[:;]-?[)(]", "", t)
        if any(bare.count(o) > bare.count(c) for o, c in opened):
            return True
    lines = t.splitlines()
    last = lines[-1].strip()
    if re.fullmatch(r"[-*+•>]|\d{1,2}[.、)）．]|[（(]\d{1,2}[)）]?|#{1,6}|[①-⑳]|第?[一二三四五六七八九十]+[、步]?", last) and len(t) > len(last):
        return True
    if last.startswith("|") and (not last.endswith("|") or len(last) < 3 or (re.fullmatch(r"[|\-: ]+", last) and len(lines) > 1)):
        return True
    if last.startswith("|") and (len(lines) < 2 or "|" not in lines[-2] or lines[-2].count("|") > last.count("|")):
        return True
    for m in _ANNOUNCED.finditer(t) if "：" in t or ":" in t else ():
        w = (m[1] or m[2]).lower()
        n = _NUMBER.get(w) or (int(w) if w.isdigit() else 0)
        if not 2 <= n <= 20:
            continue
        rest = t[m.end() :]
        items = len(_ITEM.findall("\n" + rest)) or len(re.findall(r"[①-⑳]|[（(]\d{1,2}[)）]|(?:首先|其次|再次|最后|其[一二三四五])", rest))
        if not items:
            items = len(re.findall(r"[^。；;!！?？\n]{4,}(?:[。；;!！?？\n]|\.(?=\s|$)|$)", rest))
        if items < n:
            return True
    end = t[-1]
    if end in "，,、：:=+×·/(（[【{《“-–—&^<*" and not re.search(r"[*_]{1,2}$", t):
        return not (end in "-–—" and re.fullmatch(r"[-–—*_ ]+", last))
    if end in "。.!！?？…；;）)]】」』》”\"'’|`~*_}»％%" or unicodedata.category(end) in ("So", "Sm"):
        return False
    if "=" in last or last.startswith("|"):
        return False
    if m := _ITEM.match(last):
        before = [x.strip() for x in lines[:-1] if _ITEM.match(x)]
        stops = sum(x[-1] in "。.!！?？；;" for x in before)
        return bool(before) and stops > len(before) / 2
    return len(letters(t)) >= 12


def defect(question: str | None, answer: str, question_has_content: bool) -> str | None:
    """The defect of an answer that has content."""
    if question_has_content and is_copy(question, answer):
        return "copied"
    if is_refusal(answer):
        return "refusal"
    if question_has_content:
        a = language(answer)
        if a and (q := language(question)) and a != q and not asked_for(question, a):
            return "other_language"
    return "truncated" if is_truncated(answer) else None


def _flag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["defect"] = [defect(q, a, b) if full else "empty" for q, a, b, full in zip(pdf.question, pdf.answer, pdf.asks, pdf.full)]
        yield pdf.loc[pdf.defect.notna(), ["record_id", "defect"]]


def flag_pairs(pairs: DataFrame, record_set: str) -> DataFrame:
    """record_set, record_id, defect of rows (record_id, question, answer); one pass, no shuffle."""
    asks, full = has_content(F.col("question")).alias("asks"), has_content(F.col("answer")).alias("full")
    ready = pairs.filter(F.col("record_id").isNotNull()).select("record_id", "question", F.coalesce("answer", F.lit("")).alias("answer"), asks, full)
    found = ready.mapInPandas(_flag, "record_id bigint, defect string")
    return found.select(F.lit(record_set).alias("record_set"), "record_id", "defect")


def chat_defects(chats: DataFrame) -> DataFrame:
    """Defects of the completed current rows. Each state is judged where it is read, so that only (id, time, verdict) is shuffled; texts of rows not completed stay outside Python."""
    done = is_completed(F.col("status"))
    state = chats.filter(F.col("chat_id").isNotNull()).select(
        "chat_id", "update_time", "create_time", done.alias("done"), (done & has_content(F.col("question"))).alias("asks"), (done & has_content(F.col("answer"))).alias("full"),
        F.when(done, F.col("question")).alias("question"), F.when(done, F.col("answer")).alias("answer"),
    )

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["defect"] = [
                (("empty" if not full else defect(q, a, b)) if done else None) for q, a, b, full, done in zip(pdf.question, pdf.answer, pdf.asks, pdf.full, pdf.done)
            ]
            yield pdf[["chat_id", "update_time", "create_time", "done", "defect"]]

    seen = state.mapInPandas(judge, "chat_id bigint, update_time timestamp_ntz, create_time timestamp_ntz, done boolean, defect string")
    now = seen.groupBy("chat_id").agg(F.max(F.struct("update_time", "create_time", "done", "defect")).alias("s"))
    return now.filter("s.done and s.defect is not null").select(F.lit("chat").alias("record_set"), F.col("chat_id").alias("record_id"), F.col("s.defect").alias("defect"))


def training_defects(samples: DataFrame) -> DataFrame:
    rows = samples.select(F.col("request_id").alias("record_id"), F.col("query").alias("question"), "answer")
    return flag_pairs(rows, "training").groupBy("record_set", "record_id").agg(F.min("defect").alias("defect"))
