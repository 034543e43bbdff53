"""Whether a comment states, in any of several languages, that a tool made the file.

A statement needs more than a verb: the file as its subject ("this file was produced by
x"), or that it came about by machine ("machine-written by x"), or a clause that
forbids edits beside it ("produced by x; edits are lost"). Verbs that people are
the subject of as well ("created by x") count only with one of the latter two.
"""

from __future__ import annotations

import re
import unicodedata

#: Words of the statements. STRONG verbs have tools as their subject, WEAK ones people too.
_MACHINE = r"(?:auto(?!r)\w*|automát\w*|machine|mechanically|programmatically|tool|computer|maschinell|mécaniquement|автоматич\w*|автоматически|otomatik\w*|자동(?:으로)?|自動(?:的に)?|自动)"
_STRONG_EN = r"(?:generated|produced|emitted|synthesi[sz]ed|transpiled)"
_WEAK_EN = r"(?:written|created|made|built|compiled|rendered|output)"
_BY_EN = r"(?:by|from|with|using|via|through|out of)"
_THIS_EN = r"\b(?:this|the present) (?:source |header |output )?(?:file|code|module|source|document|script|header|program|page|unit)"
_STRONG = (
    r"(?:erzeugt|generiert|généré\w*|produite?s?|generad[oa]s?|producid[oa]s?|gerad[oa]s?|produzid[oa]s?|generat[oaie]|prodott[oa]|сгенерирован\w*|згенерован\w*"
    r"|gegenereerd|wygenerowan\w*|genererad\w*|genereret|generert|vygenerován\w*|üretil\w*|oluşturul\w*|生成|產生|产生|생성)"
)
_WEAK = r"(?:erstellt|geschrieben|créée?s?|écrite?s?|cread[oa]s?|escrit[oa]s?|criad[oa]s?|creat[oaie]|scritt[oa]|создан\w*|створен\w*|gemaakt|utworzon\w*|skapad\w*|oprettet|opprettet|vytvořen\w*|作成|出力|创建|建立|작성)"
_NOUN = r"(?:fichier|code|datei|quelltext|quellcode|archivo|fichero|código|arquivo|ficheiro|file|codice|файл|код|bestand|plik|soubor|fil|dosya)"
_THIS = re.compile(
    r"\b(?:diese[rs]? (?:datei|code|quelltext|quellcode|modul)|dies) (?:wurde|wird|ist)\b.{0,160}?\b(?:erzeugt|generiert)(?: worden)?(?:\W*$|\s*[.,;:!)–—-]|\s+und\b)"
    r"|\bdit bestand (?:is|werd|wordt)\b.{0,160}?\b(?:gegenereerd)(?:\W*$|\s*[.,;:!)–—-]|\s+(?:door|uit|met|en)\b)"
    r"|\b(?:ce (?:fichier|code|module|document)|(?:est[ea]|questo|o presente|el presente) (?:archivo|fichero|código|arquivo|ficheiro|file|codice|documento)) (?:est|a été|fut|fue|ha sido|es|está|é|foi|è|è stato|viene|è stata|se ha)(?:\W+\w+){0,2}?\W+" + _STRONG +
    r"|\b(?:этот|данный|цей|ten|denna|denne|tento|bu) (?:файл|код|plik|fil|soubor|dosya)(?:\W+\w+){0,3}?\W+" + _STRONG +
    r"|(?:この|本)(?:ファイル|コード|ソース)\w*は.{0,160}?(?:生成|出力)(?:され(?:ました|ています|たもの|たファイル|た(?=[。.!\s(（]|$)|る(?=[。.!\s]|$)|ます)|した?もの|物)"
    r"|(?:本|此|该|這個|这个|該)(?:文件|檔案|代码|程式碼|源文件|源代码)\s*(?:是|为|為|系)?\s*(?:由|使用|通过|透過|用|自动|自動).{0,160}?(?:生成|產生|产生)(?!的?代码\w*(?:在|会))"
    r"|이 (?:파일|코드)(?:은|는).{0,160}?생성(?:되었|됨|된 파일|했)",
    re.I,
)
_STATED_EN = re.compile(
    rf"{_THIS_EN}\W+(?:(?:is|was|were|has been|had been|gets|is being)\W+)?(?:{_MACHINE}[- ]?)?{_STRONG_EN}\W+(?:{_MACHINE} )?{_BY_EN}\b"
    rf"|(?:^\W*(?:(?:source|code|file|module|header)\W+)?|{_THIS_EN}\W+(?:(?:is|was|were|has been)\W+)?){_MACHINE}[- ]?(?:{_STRONG_EN}|{_WEAK_EN})(?:\W+(?:file|source|code))?(?:\W+{_BY_EN}\b|\s*[,.:;!]|\W*$)"
    rf"|(?:^\W*(?:(?:source|code|file|module|header)\W+)?|{_THIS_EN}\W+(?:(?:is|was|were|has been)\W+)?)(?:{_STRONG_EN}|{_WEAK_EN})\W+{_MACHINE}\W+{_BY_EN}\b",
    re.I,
)
_STATED_ELSE = re.compile(
    rf"^\W*(?:{_NOUN}\s+)?(?:{_MACHINE}\W*(?:{_STRONG}|{_WEAK})|(?:{_STRONG}|{_WEAK})\s+{_MACHINE})(?!\w*(?:コード|的?代码)\w)|^\W*{_NOUN}\s+{_STRONG}\s+(?:par|von|mit|aus|por|con|desde|da|de|à partir|door|met|uit|przez|av|af)\b",
    re.I,
)
_MADE_BY = re.compile(rf"\b(?:{_STRONG_EN}|{_WEAK_EN})\W+(?:{_MACHINE} )?{_BY_EN}\b|{_STRONG}|{_WEAK}", re.I)
#: Edits are forbidden, or lost; "without telling x" speaks of something within.
_HANDS_OFF = re.compile(
    r"\b(?:do not|don'?t|never|must not|should not|not to) (?:be )?(?:hand-?|manually )?(?:edit|modif|chang|touch|alter)\w*(?!.*\bwithout\b)"
    r"|\b(?:edits|changes|modifications)\b[^.]{0,40}\b(?:are|will be|get|may be)\W+(?:overwritten|lost|discarded|undone|reverted)"
    r"|\bnicht (?:von hand |manuell |direkt )?(?:bearbeiten|ändern|editieren|verändern|modifizieren)\b|\bänderungen (?:gehen verloren|werden überschrieben)"
    r"|\bne (?:pas|jamais) (?:l[ea'] ?)?(?:modifier|éditer|changer|toucher)|\b(?:no|não|nao) (?:lo |o )?(?:edit|modifi|toc|toque|cambi|alter)\w*|\bnon (?:modificare|editare|toccare)"
    r"|\bне (?:редактир|измен|правьте|править|модифіц|редагу|змін)\w*|\bniet (?:handmatig )?(?:bewerken|wijzigen|aanpassen)|\bnie (?:edytu|edytować|modyfik|zmienia)\w*|\b(?:redigera|ändra|rediger|endre|ret) (?:inte|ikke)|\bneupravu\w*|\bdüzenlemeyin|\bdeğiştirmeyin"
    r"|(?:編集|変更|修正)(?:を?し)?ない|(?:編集|変更|修正)(?:禁止|不可)|(?:请勿|請勿|请不要|請不要|不要|勿|切勿)(?:手动|手動|直接|人工)?(?:修改|编辑|編輯|更改|改动)|(?:수정|편집|변경)하지",
    re.I,
)
#: What denies it, in the other languages.
_DENIED = re.compile(
    r"\b(?:nicht|kein\w*|früher|nicht mehr|ursprünglich)\b.{0,40}\b(?:erzeugt|generiert|erstellt)\b(?!.*\bnicht (?:von hand |manuell )?(?:bearb|änd|edit))|\bvon hand (?:geschrieben|erstellt|gepflegt)|handgeschrieben"
    r"|\bn(?:'est|'a) (?:pas|plus)\b|\bautrefois\b|\b(?:écrit|rédigé|maintenu)\w* à la main|\b(?:no|ya no|não|non) (?:es|fue|está|ha sido|é|foi|è) (?:\w+ )?(?:gen|prod|crea|cria|ger)|\b(?:escrit[oa]|scritt[oa]) (?:a|à) (?:mano|mão)"
    r"|\bне (?:был\w* )?(?:автоматически )?(?:сгенер|создан|генерир)|вручную (?:написан|создан)|\bnie (?:jest|został)|\bniet (?:automatisch )?gegenereerd"
    r"|(?:生成|出力|作成)(?:された(?:もの|ファイル)では|され(?:て(?:い)?)?(?:ません|ない))|手書き|手動で(?:書|作成)|以前は|(?:不是|并非|並非|非).{0,12}(?:生成|產生)|手写|手工编写|생성(?:되지|된 것이 아)",
    re.I,
)

#: A part of every verb above, in lower case; a plain look for these comes first, as most comments have none.
_STEMS = "generat generad generi généré gerad produ prodott emitted synthesi transpiled written created made built compiled rendered output erzeugt генер generert genererad genereret gegenereerd wygenerowan vygenerován üretil oluşturul 生成 產生 产生 생성 erstellt geschrieben créé écrit cread escrit criad creat scritt создан створен gemaakt utworzon skapad oprettet opprettet vytvořen 作成 出力 创建 建立 작성".split()


def may_say_so(comments: str) -> bool:
    """False if no verb of the statements is among ``comments``."""
    x = unicodedata.normalize("NFC", comments).lower()
    return any(s in x for s in _STEMS)


def says_generated(comment: str) -> bool:
    """If ``comment``, without its marks, states that its file was made by a tool."""
    x = unicodedata.normalize("NFC", comment)
    if not may_say_so(x) or _DENIED.search(x):
        return False
    return bool(_STATED_EN.search(x) or _THIS.search(x) or _STATED_ELSE.search(x) or _HANDS_OFF.search(x) and _MADE_BY.search(x))
