"""Problem 8: personal information inside free text, by anchor expansion.

An Aho-Corasick automaton runs once over each whole text (full-width signs folded and digits set to 0, one sign for one) and finds
anchors: at-signs and their spellings, digit shapes, street words, cues and verbs that stand next to names. From each anchor a deterministic
local parser expands left and right and validates: domains, dates and check characters, dialling formats, address grammar,
family names. Text that no anchor touches is never parsed.

Kinds, in the order in which overlapping finds win: email, id_number, phone, address, name. redact() puts [EMAIL], [ID_NUMBER], [PHONE],
[ADDRESS] and [NAME] in their place and leaves the rest as it is.

Defined cases: null and empty texts give nothing; a repeated value counts once a document; rows without doc_id give no row;
a long text is read whole; values keep their spelling.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FOLD = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20, 0xA0: 0x20, 0x2010: 0x2D, 0x2011: 0x2D, 0x2013: 0x2D, 0x202F: 0x20}
_ZERO = {0x30 + i: 0x30 for i in range(10)}

# Anchors by kind of parser.
EMAIL_ANCHORS = ["@", "(at)", "[at]", "{at}", "<at>", "(AT)", "[AT]", "{AT}", " dot ", " DOT "]
NUMBER_ANCHORS = ["+0", "(0", "000-0", "000 0", "000.0", "00-0000", "00 0000", "0000000", "00 00 00", "00.00.00"]
ZH_ROADS = ["路", "街", "巷", "道", "弄", "胡同", "里", "坊"]
EN_ROADS = [
    "Road", "Street", "Lane", "Crescent", "Avenue", "Drive", "Close", "Court", "Terrace", "Square", "Boulevard", "Gardens", "Grove", "Hill", "Mews", "Row", "Walk", "Way", "Place", "Parkway",
    " Rd", " St", " Ave", " Ln", " Dr", " Blvd",
]
DE_ROADS = ["Straße", "Strasse", "straße", "strasse", "Str.", "str.", "Weg", "weg ", "Allee", "allee ", "Gasse", "gasse ", "Platz", "platz ", "Ring", "ring ", "Ufer", "ufer "]
FR_ROADS = ["rue ", "avenue ", "boulevard ", "chemin ", "place ", "quai ", "allée ", "impasse ", "route ", "cours ", "passage "]
ZH_BEFORE = ["联系人", "值班员", "负责人", "专责", "收件人", "登记", "据", "由", "监护人", "工作人员", "经办人", "签发人", "操作人", "姓名", "班长", "调度员", "工程师", "主任", "、", "住户", "家属"]
ZH_AFTER = ["认为", "则主张", "主张", "回忆", "已签字", "签字", "会签", "收", "于当日", "要求", "负责", "(", "反映", "完成", "表示", "称", "说", "告知"]
WEST_BEFORE = [
    "Contact: ", "Contact : ", "contact ", "ask for ", "According to ", "according to ", "attention of ", "done by ", "checked by ", "signed by ", "written by ", "approved by ", "lists ", "Attn: ", "attn. ",
    "Ansprechpartner ist ", "Ansprechpartnerin ist ", "gehen an ", "Laut ", "laut ", "durch ", "von ", "envoyer à ", "Selon ", "selon ", "D'après ", "d'après ", "d’après ", "demander ", "par ", "Name: ", "Nom : ", "name is ",
    "Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Herr ", "Frau ", "Mme ",
]
WEST_AFTER = [" signed ", " heard ", " said ", " reported ", " unterschrieb", " hat ", " a signé", " confirme", ", phone", ", Telefon", ", téléphone", ", tel"]
# Frequent family names, of two signs and of one.
DOUBLE = "欧阳 太史 端木 上官 司马 东方 独孤 南宫 万俟 闻人 夏侯 诸葛 尉迟 公羊 赫连 澹台 皇甫 宗政 濮阳 公冶 太叔 申屠 公孙 慕容 仲孙 钟离 长孙 宇文 司徒 鲜于 司空 令狐 百里 呼延 东郭 南门".split()
SINGLE = set(
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄和穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋茅庞熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯管卢莫经房裘缪干解应宗丁宣邓郁单杭洪包诸左石崔吉龚程邢裴陆荣翁荀甄曲家封芮储靳汲井段富巫乌焦巴弓牧隗山谷车侯宓全班仰秋仲伊宫宁仇栾暴甘厉戎祖武符刘景詹束龙叶幸司韶黎薄印宿白怀蒲台从鄂索咸籍赖卓蔺屠蒙池乔阴胥能苍双闻莘党翟谭贡劳逄姬申扶堵冉宰郦雍桑桂濮牛寿通边扈燕冀浦尚农温别庄晏柴瞿阎连习容向古易慎戈廖庾终居衡步都耿满弘匡国文寇广禄东欧利师巩聂关荆肖覃覃闫佘"
)
NOT_NAMES = {"应立即", "应考虑", "平均", "经验", "安全", "安装", "温度", "高压", "高温", "马达", "金属", "黄铜", "钱箱", "方案", "方可", "常见", "和长", "时间", "于是", "成功", "明显", "时应", "应先", "应与", "从而", "能否", "通信", "经过", "单元", "连接", "关于", "广泛", "都要", "全部", "强度", "計算"}
_GIVEN_NOT = set("的了是在和与或及应需将被为从对按由于因如若则即并且不未已可能会要使把让等个这那其之以至往上下中内外前后时年月日点分秒号米千伏安瓦路街巷市省县区镇站变线厂柜箱器机组件阀泵表值度压流率量收")

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_AT = r"(?: ?@ ?| ?(?:\((?:at|AT)\)|\[(?:at|AT)\]|\{(?:at|AT)\}|<(?:at|AT)>) ?| (?:at|AT) (?=[A-Za-z0-9-]+ (?:dot|DOT) ))"
_DOT = r"(?:\.| ?(?:\((?:dot|DOT)\)|\[(?:dot|DOT)\]|\{(?:dot|DOT)\}) ?| (?:dot|DOT) )"
EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{{0,62}}[A-Za-z0-9_%+-])?{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9@])")
ID18 = re.compile(r"(?<![\dA-Za-z.])(\d{6})([ -]?)(\d{8})([ -]?)(\d{3}[\dXx])(?![\dA-Za-z]|[-.]\d)")
ID324 = re.compile(r"(?<![\d+.-])(?<!\d[ ])\d{3}([- ])\d{2}\1\d{4}(?![\d]|[-.]\d)")
_PHONES = [
    r"\+86[ -]?1[3-9]\d[ -]?\d{4}[ -]?\d{4}", r"\+86[ -]?\(?0?\d{2,3}\)?[ -]?\d{7,8}", r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}",
    r"\+44[ -]?(?:\(0\) ?)?\d{2,5}[ -]?\d{3,4}[ -]?\d{3,6}", r"\+33[ .-]?(?:\(0\) ?)?[1-9](?:[ .-]?\d{2}){4}", r"\+49[ -]?(?:\(0\) ?)?\d{2,5}[ /-]?\d{3,9}(?:[ -]\d{1,5})?",
    r"\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,5}",
    r"\(0\d{2,4}\)[ -]?\d{3,5}[ -]?\d{3,5}", r"\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}",
    r"1[3-9]\d([ -]?)\d{4}\1\d{4}", r"0\d{2,3}-\d{7,8}", r"\d{3}([-. ])\d{3}\2\d{4}", r"0[1-9](?:[ .-]?\d{2}){4}",
    r"0\d{2,4}[ /]\d{3,8}(?:[ -]\d{2,5}){0,2}", r"0\d{3,4} \d{3} ?\d{3,4}",
]
PHONE = re.compile(r"(?<![A-Za-z0-9_./+-])(?<!\d:)(?:" + "|".join(f"(?:{p})" for p in _PHONES) + r")(?![\dA-Za-z]|[-./:]\d| ?(?:kV|V|A|MW|MVA|kWh|ms|Hz|%|℃|Ω)\b)")
# Looked for in the 16 signs before a number: the longest cue (serial number) and three signs.
_SERIAL = re.compile(r"(?:序列号|编号|单号|序号|批号|型号|serial number|number|Nummer|numéro|order|ordre|Auftrag|No\.|reading|读数|factor|Asset|asset)[为是:： ]{0,3}$", re.I)

_ZH_UNIT = r"(?: ?\d{1,4}(?:号楼|号院|号|弄|栋|幢|座|单元|室|层|楼|户|门))"
ZH_STREET = re.compile(rf"(?:路|街|巷|道|弄|胡同|里|坊) ?\d{{1,5}}(?:号楼|号院|号|弄|巷)(?:之\d+)?{_ZH_UNIT}*(?: ?\d{{1,5}}(?![\d.]|[A-Za-z%℃年月日天分秒毫米]))?")
_ZH_CUE = re.compile(r".*(?:住址|地址为|地址是|地址|寄往|寄至|寄到|送至|送到|位于|住在|家住|现住|搬到|前往|户籍)[为是在:： ]{0,2}")
_ZH_PLACE = re.compile(r"省|市|区|县|镇|乡|州")
_CAP = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿß'’]+"
_TOWN = rf"{_CAP}(?:-{_CAP})*(?:(?: (?:am|an der|im|bei|ob der|upon|on|under|sur|sous|les|lès|le|la|de)|-(?:sur|sous|les|le|la|en|upon|on|de)-?)(?: |-){_CAP}| {_CAP})*"
_UNIT = r"(?:,? (?:Apt\.?|Apartment|Unit|Floor|Suite|Flat|Room|Ste\.?|#) ?[A-Za-z0-9-]{1,6})"
EN_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9.,/-])\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,4}}(?:Road|Street|Lane|Crescent|Avenue|Drive|Close|Court|Terrace|Square|Boulevard|Gardens|Grove|Hill|Mews|Row|Walk|Way|Place|Parkway|(?:Rd|St|Ave|Ln|Dr|Blvd)\b\.?)"
    rf"(?![a-z]){_UNIT}*(?:, {_TOWN}(?![a-z]))?(?:,? (?:[A-Z]{{2}} \d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}}|\d{{5}}))?"
)
DE_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9-])(?:(?:{_CAP}(?:-| ))+(?:Straße|Strasse|Str\.|Weg|Allee|Gasse|Platz|Ring|Ufer)|{_CAP[:-1]}*(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|ufer)) ?\d{{1,4}} ?[a-z]?(?![a-zA-Z0-9])(?:, (?:D-)?\d{{5}} {_TOWN})?"
)
FR_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9.,/-])\d{{1,4}}(?: (?:bis|ter|quater)|[A-D])?,? (?:rue|avenue|boulevard|chemin|place|quai|allée|impasse|route|cours|passage) (?:(?:des|de la|de l['’]|du|de|d['’]|les|la|le|l['’]) ?)?{_CAP}(?:[- ](?:{_CAP}|de|des|du|la|le|les))*(?:, \d{{5}} {_TOWN})?"
)
_WORD = r"(?:[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿß'’]+|[A-ZÀ-ÖØ-Þ]{2,})(?:-(?:[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿß'’]+|[A-ZÀ-ÖØ-Þ]{2,}))*"
_PART = r"(?:(?:von|van|de|del|di|da|der|den|zu|le|la) )?"
WEST_NAME = re.compile(rf"(?<![A-Za-zÀ-ÿ])(?:{_WORD} (?:[A-Z]\. ?)?{_PART}{_WORD}|(?:[A-Z]\. ?){{1,2}}{_PART}{_WORD}|{_WORD}, (?:{_WORD}(?: [A-Z]\.)?|[A-Z]\.))(?![a-zà-ÿA-Z])")
_NOT_WEST = re.compile(r"^(?:The|A(?!\.)|An|At|In|If|On|Over|Under|To|When|Das|Der|Die|Bei|Im|In|Nach|Le|La|Les|Pour|Si|À|Il|Es|NRS|GN|TX|Q|DW|Phase|Bay|Unit|Service|Tower|Panel|Work|Meter)\b|\b(?:Road|Street|Lane|Crescent|Straße|Str|Station|Substation|Bay|Unit|Apt|Floor)\b")


NAME_WORDS = 6  # a name by WEST_NAME has at most five words
_STREETS = {"road_en": EN_ADDRESS, "road_de": DE_ADDRESS, "road_fr": FR_ADDRESS}
_MAIL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@ ()[]{}<>")


def _reach(t: str, at: int, last: int, signs: frozenset) -> tuple[int, int]:
    """The stretch around an anchor that holds nothing but these signs."""
    left, right = at, last + 1
    while left > 0 and t[left - 1] in signs:
        left -= 1
    while right < len(t) and t[right] in signs:
        right += 1
    return left, right


_CAPITAL = re.compile(r"(?<![A-Za-zÀ-ÿ'’-])[A-ZÀ-ÖØ-Þ]")


def valid_id18(body: str) -> bool:
    """A real date of birth and the MOD 11-2 check character."""
    try:
        born = date(int(body[6:10]), int(body[10:12]), int(body[12:14]))
    except ValueError:
        return False
    total = sum(int(c) * pow(2, 17 - i, 11) for i, c in enumerate(body[:17]))
    return 1900 <= born.year <= 2100 and "10X98765432"[total % 11] == body[17].upper()


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    kinds: dict[str, list[str]] = {}
    for kind, words in (
        ("email", EMAIL_ANCHORS), ("number", NUMBER_ANCHORS), ("zh_road", ZH_ROADS), ("road_en", EN_ROADS), ("road_de", DE_ROADS), ("road_fr", FR_ROADS), ("zh_before", ZH_BEFORE), ("zh_after", ZH_AFTER), ("before", WEST_BEFORE), ("after", WEST_AFTER),
    ):
        for w in words:
            kinds.setdefault(w, []).append(kind)
    for w, ks in kinds.items():
        a.add_word(w, (len(w), ks))
    a.make_automaton()
    return a


_NUMERIC = frozenset("0123456789+()-. /")


def _number_region(t: str, at: int) -> tuple[int, int]:
    left, right = at, at + 1
    while left > 0 and t[left - 1] in _NUMERIC:
        left -= 1
    while right < len(t) and t[right] in _NUMERIC:
        right += 1
    return left, right


def _zh_surname(t: str, at: int) -> int:
    if t[at : at + 2] in DOUBLE:
        return 2
    return 1 if t[at : at + 1] in SINGLE else 0


def _is_han(c: str) -> bool:
    return "㐀" <= c <= "鿿"


_ZH_RIGHT = re.compile(r"认为|则主张|主张|回忆|已?签字|会签|收(?![到入集取])|于当日|于\d|要求|负责|反映|完成|表示|称|说|告知|电话|手机|[、，。；：,.;:()（）\s]|同志|先生|女士|和|与|及|在|$")


def _zh_name_at(t: str, at: int) -> int:
    """Length of a personal name that starts here and is followed by a sign or word that follows names, else 0."""
    n = _zh_surname(t, at)
    if not n:
        return 0
    for given in (2, 1):
        end = at + n + given
        name = t[at:end]
        if len(name) < n + given or not all(_is_han(c) and c not in _GIVEN_NOT for c in name[n:]):
            continue
        if name in NOT_NAMES or name[:2] in NOT_NAMES and given == 1:
            continue
        if _ZH_RIGHT.match(t, end):
            return n + given
    return 0


def _zh_name_before(t: str, end: int) -> int:
    """Start of a personal name that ends here and begins a sentence part, else -1."""
    for size in (4, 3, 2):
        at = end - size
        if at < 0 or (at > 0 and (_is_han(t[at - 1]) and t[at - 1] not in "据由员责人师任和与及")):
            continue
        n = _zh_surname(t, at)
        if n and 1 <= size - n <= 2 and (size < 4 or n == 2) and all(_is_han(c) and c not in _GIVEN_NOT for c in t[at + n : end]) and t[at:end] not in NOT_NAMES and t[at : at + 2] not in NOT_NAMES:
            return at
    return -1


def spans(text: str, anchors) -> list[tuple[int, int, str]]:
    """(start, end, kind) without overlaps, in order."""
    t = text.translate(_FOLD)
    found: list[tuple[int, int, int, str]] = []
    seen_number = seen_email = -1
    seen_road: dict[str, int] = {}
    for last, (size, kinds) in anchors.iter(t.translate(_ZERO)):
        at = last - size + 1
        for kind in kinds:
            if kind == "number":
                if last < seen_number:
                    continue
                left, right = _number_region(t, last)
                seen_number = right
                part_end = right + 1 if right < len(t) and t[right] in "Xx" else right
                for m in ID18.finditer(t, left, part_end):
                    if m[2] == m[4] and valid_id18(m[1] + m[3] + m[5]) and not _SERIAL.search(t, max(0, m.start() - 16), m.start()):
                        found.append((1, m.start(), m.end(), "id_number"))
                for m in ID324.finditer(t, left, part_end):
                    found.append((1, m.start(), m.end(), "id_number"))
                for m in PHONE.finditer(t, left, part_end):
                    digits = sum(c.isdigit() for c in m[0])
                    if 9 <= digits <= 15 and not _SERIAL.search(t, max(0, m.start() - 16), m.start()):
                        found.append((2, m.start(), m.end(), "phone"))
            elif kind == "email":
                if last < seen_email:
                    continue
                for m in EMAIL.finditer(t, *_reach(t, at, last, _MAIL_SIGNS)):
                    if m.start() <= last:
                        found.append((0, m.start(), m.end(), "email"))
                        seen_email = max(seen_email, m.end())
            elif kind == "zh_road":
                m = ZH_STREET.match(t, at)
                if m:
                    left = at
                    while left > 0 and (_is_han(t[left - 1]) or (t[left - 1] == " " and left > 1 and _is_han(t[left - 2]))):
                        left -= 1
                    head = t[left:at]
                    cue = _ZH_CUE.match(head)
                    start = left + (cue.end() if cue else 0)
                    while start < at and t[start] == " ":
                        start += 1
                    head = t[start:at]
                    if head and (cue or _ZH_PLACE.search(head)) and not re.search(r"(?:回|电|线|短|支|馈|旁|通|开)$", head):
                        found.append((3, start, m.end(), "address"))
            elif kind in _STREETS:
                if last < seen_road.get(kind, -1):
                    continue
                a, b = t.rfind("\n", 0, at) + 1, t.find("\n", last)  # an address stands in one line, which is searched once
                b = len(t) if b < 0 else b
                seen_road[kind] = b
                for m in _STREETS[kind].finditer(t, a, b):
                    found.append((3, m.start(), m.end(), "address"))
            elif kind == "zh_before":
                start = last + 1
                while start < len(t) and t[start] in ":： ":
                    start += 1
                if n := _zh_name_at(t, start):
                    found.append((4, start, start + n, "name"))
            elif kind == "zh_after":
                start = _zh_name_before(t, at)
                if start >= 0 and (t[at] != "(" or re.match(r"\((?:\+?\d|\(0)", t[at : at + 3])):
                    found.append((4, start, at, "name"))
            elif kind == "before":
                m = WEST_NAME.match(t, last + 1)
                if m and not _NOT_WEST.search(m[0]):
                    found.append((4, m.start(), m.end(), "name"))
            else:
                a = at
                for _ in range(NAME_WORDS):
                    a = max(0, t.rfind(" ", 0, a))
                for start in _CAPITAL.finditer(t, a, at):
                    m = WEST_NAME.fullmatch(t, start.start(), at)
                    if m and not _NOT_WEST.search(m[0]):
                        found.append((4, m.start(), m.end(), "name"))
                        break
    found.sort(key=lambda x: (x[0], x[1] - x[2], x[1]))
    out: list[tuple[int, int, str]] = []
    for _, s, e, kind in found:
        if all(e <= a or s >= b for a, b, _ in out):
            out.append((s, e, kind))
    return sorted(out)


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, kind in found:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))


def find(documents: DataFrame) -> DataFrame:
    """doc_id, kind, value: each distinct value of a document. No shuffle but for documents that stand in more than one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = automaton()
        for pdf in batches:
            rows = {(d, kind, t[s:e]): None for d, t in zip(pdf.doc_id, pdf.text) for s, e, kind in spans(t, anchors)}
            yield pd.DataFrame(list(rows), columns=["doc_id", "kind", "value"])

    return _texts(documents).mapInPandas(run, "doc_id bigint, kind string, value string").distinct()


def redacted(documents: DataFrame) -> DataFrame:
    """doc_id, text with typed placeholders; rows with null or empty text keep it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = automaton()
        for pdf in batches:
            pdf["text"] = [t if not t else redact(t, spans(t, anchors)) for t in pdf.text]
            yield pdf

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, text string").distinct()
