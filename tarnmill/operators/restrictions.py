"""Restrictions in the text of a posting: who may apply. Ordered checks with what around a passage lifts them.

Wordings are our own and composed of parts, so that common phrasings are covered; a text is taken in lower case with
white space squeezed, and whole."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnmill.functions.places import ABROAD, PROVINCES, STATES

_US = r"(?:u\.?s\.?(?:a\.?)?|united states|american)"
_BACHELOR = r"(?:(?:an?|the|their|your) )?(?:4[- ]year |four[- ]year |full[- ]time )?(?:undergraduate|bachelor(?:'?s)?|b\.?[sa]\.?(?:/b\.?[sa]\.?)?|bsee|bsme|bscs)(?![a-z])"
_YEAR = r"(?:sophomore|junior|senior|third|fourth|final)"
_PHD = r"(?:ph\.?d\.?|doctoral|doctorate)"
_OTHER_FIELD = r"(?:aerospace|agricultural|biomedical|chemical|civil|electrical|industrial|materials|mechanical|nuclear|petroleum|structural)"
_COMPUTING = r"computer|software|information (?:technology|systems)|data science|\bcs\b|related (?:field|discipline)"
_GRADUATES = r"\bmaster(?:'?s)?\b|\bgraduate\b|\bgrad student|\bms/phd|\bm\.s\.|\bms degree|\bor ms\b|advanced degree|higher degree|or higher"


def mentions(low: Column, words: str) -> Column:
    """Whether a text holds any of the plain strings (parted by |)."""
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words.split("|")])


def _parts(wording: str) -> list[str]:
    """The alternatives of a pattern outside of its groups."""
    parts, depth, listed, escaped = [""], 0, False, False
    for c in wording:
        if not escaped and not listed:
            depth += (c == "(") - (c == ")")
        if not escaped:
            listed = c == "[" or (listed and c != "]")
        if c == "|" and not depth and not listed and not escaped:
            parts.append("")
        else:
            parts[-1] += c
        escaped = c == "\\" and not escaped
    return parts


def at_words(wordings: list[str]) -> str:
    """Any of the wordings, in order. Neighbours that all begin at the edge of a word are sought at beginnings of words
    only: the edge is looked for once at each place, and after the sign that follows it, not once for each wording."""
    parts = [p for w in wordings for p in _parts(w)]
    runs = [(edge, list(run)) for edge, run in groupby(parts, lambda p: p.startswith(r"\b"))]
    return "(?:" + "|".join(r"(?=\w)\b(?:" + "|".join(p[2:] for p in run) + ")" if edge else "|".join(run) for edge, run in runs) + ")"


def _bound(value: Column, what) -> Column:
    """what(value): bound to a variable, so that it is made once however often it is used."""
    return F.get(F.transform(F.array(value), what), 0)


@dataclass
class Check:
    """Any of `wordings`, unless `lifted` occurs within `around` signs of it or `never` anywhere in the text. Each wording
    holds one of the plain strings `needs`: texts without any, which are most, are told by these alone."""

    reason: str
    needs: str
    wordings: list[str]
    lifted: str | None = None
    around: int = 500
    never: str | None = None
    pattern: str = field(init=False)

    def __post_init__(self) -> None:
        self.pattern = at_words(self.wordings)

    def holds(self, low: Column) -> Column:
        found = mentions(low, self.needs) & low.rlike(self.pattern)
        if self.lifted is not None:  # what is around passages is cut out for the few texts that hold one
            found = found & F.exists(self._contexts(low), lambda c: ~c.rlike(self.lifted))
        return found & ~low.rlike(self.never) if self.never else found

    def _contexts(self, low: Column) -> Column:
        """What is around each passage: passages and what lies between them give the places."""
        between = F.transform(F.split(low, self.pattern, -1), F.length)
        lengths = F.transform(F.regexp_extract_all(low, F.lit(self.pattern), F.lit(0)), F.length)
        total = lambda c, n: F.aggregate(F.slice(c, 1, n), F.lit(0), lambda s, x: s + x)

        def cut(start: Column, length: Column) -> Column:
            first = F.greatest(F.lit(0), start - self.around)
            return F.substring(low, first + 1, start + length + self.around - first)

        # bound, so that the text is searched once for each and not once for each use
        places = lambda b, l: F.transform(l, lambda n, i: _bound(total(b, i + 1) + total(l, i), lambda start: cut(start, n)))
        return _bound(between, lambda b: _bound(lengths, lambda l: places(b, l)))

    def passage(self, low: Column) -> Column:
        """The first passage with 60 signs on either side, for a log."""
        at = F.regexp_instr(low, F.lit(self.pattern))
        first = F.greatest(F.lit(1), at - 60)
        return F.substring(low, first, at - first + F.length(F.regexp_extract(low, self.pattern, 0)) + 60)


CLEARANCE = Check("clearance", "clearance|ts/sci|polygraph|top secret|dod secret|itar|eligible|export", [
    r"\bclearance\b.{0,60}\b(?:required|preferred|needed|eligib\w+)", r"\b(?:obtain|acquire|get|hold|maintain|possess)(?:ing|s)?\b.{0,60}\bclearance\b", r"\b(?:eligib\w+|able|ability)\b.{0,60}\bclearance\b", r"\bcitizen\w*\b.{0,80}\bclearance\b",
    r"\b(?:active|current|secret|security) clearance\b", r"\bts/sci\b|\bpolygraph\b|\btop secret\b|\bdod secret\b", r"\bitar\b.{0,60}\b(?:complian\w+|eligib\w+|required|restrict\w+)", r"\bear ?/ ?itar\b|\bear[- ]eligible\b",
    r"\bexport[- ]controlled\b.{0,40}\b(?:information|technolog\w+|data|items)", r"\bexport control\w*\b.{0,60}\b(?:required|complian\w+|restrict\w+)", rf"\b{_US} export control", r"\bexport administration regulations\b",
])
CITIZENSHIP = Check("citizenship", "citizen|sponsor|work visa", [
    rf"\b{_US} citizens?\b", rf"\b{_US} citizenship\b", r"\bcitizenship (?:is (?:a )?)?(?:required|requirement|necessary|mandatory)", r"\bauthori[sz]ed to work\b.{0,80}\bwithout\b.{0,30}\bsponsor", r"\blegal right to work\b.{0,80}\bwithout\b.{0,30}\bsponsor",
    r"\bwithout requiring sponsorship\b", r"\bnot\b.{0,30}\brequire\b.{0,40}\bsponsorship\b.{0,30}\bfuture", r"\bno (?:visa|employment|work) sponsorship\b.{0,60}\b(?:now|future|available)", r"\bnot eligible for\b.{0,60}\b(?:sponsor\w*|work visa)", r"\bemployment sponsorship (?:is )?not\b",
])
GRADUATE_BY = Check("graduation date", "graduat|complet|fall", [
    r"\bgraduat(?:e|es|ing|ion)\b.{0,20}\b(?:by|before|no later than|in|prior to)\b (?:the )?(?:end of )?(?:fall|autumn|december|dec\.?)(?: of)? 20(?:1\d|2[0-6])\b", r"\b(?:fall|december|dec\.?) 20(?:1\d|2[0-6]) graduat",
    r"\bgraduating (?:fall|december) 202[0-6]", r"\bcomplet(?:e|es|ing) (?:(?:an?|the|their|your) )?(?:degree|program|master\w*|ms)\b.{0,15}\b(?:by|in|before)\b.{0,10}\b(?:fall|december|dec\.?) 20(?:1\d|2[0-6])", r"\b(?:juniors|seniors|students) in (?:the )?fall (?:of )?2026",
])
PERMANENT = Check("permanent authorization", "permanent|indefinite|unrestricted|green card|f-1|f1|visa", [rf"\bpermanent(?:ly)? (?:{_US} )?(?:work |employment )?authori[sz]", r"\b(?:indefinite|unrestricted|permanent) (?:right|authori[sz]ation|permission) to work\b", r"\b(?:green card|permanent resident)s?(?: holders?| status)? (?:only|(?:is |are )?required)", r"\b(?:f-?1|temporary visa|student visa)(?: holders?| status)?(?: students?)? (?:are |is |will )?(?:not|cannot|ineligible)\b"])
HIGH_SCHOOL = Check("high school", "high school|high-school", [r"\bhigh[- ]school(?:ers?| students?| seniors?| juniors?) (?:only|are eligible|may apply|program|internship)", r"\b(?:current|rising|must be an?) high[- ]school (?:student|senior|junior)", r"\b(?:attending|enrolled in|still in) high[- ]school\b", r"\bhigh school diploma only\b", r"\bfor high[- ]school(?:ers| students)\b"])
UNDERGRADUATE = Check("undergraduate only", "bachelor|undergraduate|junior|senior|sophomore|college|third|fourth|final|pursu|obtain|enrolled|complet|graduating|working toward|studying for|attending|associate|class standing", [
    rf"\b(?:pursuing|obtaining|attending|completing|studying for|working towards?|enrolled (?:in|as)|(?:pursue|obtain|complete))(?: towards?)? {_BACHELOR}", rf"\b(?:rising|entering|incoming|going into|advancing (?:in)?to)(?: (?:their|the|your|an?))? {_YEAR}\b",
    rf"\b{_YEAR}(?: or (?:junior|senior))?(?: year)? (?:standing|status)\b", rf"\b(?:must|should) be an? {_YEAR}(?: or senior)?(?: year)? ?(?:student|in college)?", r"\b(?:junior|senior) or senior year\b", r"\bclass standing ?: ?(?:junior|senior|sophomore)", r"\b(?:junior|senior)s? pursuing\b",
    r"\bundergraduates?(?: students?)? only\b", r"\bonly (?:open to )?undergraduate", r"\bundergraduate (?:intern\b|interns\b|internship|enrol\w+|status|student status|students? pursuing|program student)", r"\bintern,? undergraduate\b", r"\b(?:must be|for|current|an?) undergraduate students?\b",
    r"\b(?:currently|must be)(?: an?)?(?: enrolled)?(?: as)?(?: an?)? college student\b", r"\bbachelor'?s? (?:level )?(?:students?|candidates?|enrolment|enrollment)\b", r"\bbachelor'?s? (?:degree )?program enrol", r"\bassociate'?s?(?: degree)? (?:or|and) (?:an? )?bachelor",
    r"\bcompleted? (?:2|3|two|three|sophomore|junior)(?: full)? years?\b", r"\bgraduating\b.{0,40}\bwith (?:an? )?(?:ba|bs|b\.a\.|b\.s\.)\b", r"\benrolled\b.{0,40}\b(?:4|four)[- ]year (?:college|university|degree|program)", r"\baccredited four[- ]year (?:college|university)",
], lifted=_GRADUATES)
OTHER_DEGREE = Check("degree field", "degree in|bachelor|bs in|bsee|bsme|bsce|bsche|major|enrolled in| engineering ", [rf"\b(?:degree|bachelor'?s?|bs|major(?:ing)?|enrolled) in {_OTHER_FIELD}", r"\bbs(?:ee|me|ce|che)\b", rf"\b{_OTHER_FIELD} engineering (?:degree|major|student)s?\b", r"\bdegree in (?:nursing|accounting|law|marketing|finance)\b"], lifted=_COMPUTING, around=200)
PHD = Check("phd only", "phd|ph.d|doctora|3rd", [
    rf"\b{_PHD} (?:intern\w*|students?|candidates?|only|required|degree|program|research intern)", rf"\b(?:pursuing|obtaining|enrolled in|completing) (?:an? )?{_PHD}", rf"\b(?:requires?|must have|must be pursuing|required) .{{0,30}}\b{_PHD}", rf"\({_PHD}\)", r"\b3rd[- ]year ph",
], lifted=r"\bmaster|\bms\b|\bm\.s\.|\bbachelor|\bbs\b|graduate student|or equivalent|preferred", never=r"\b(?:bs|ba|bachelor'?s?) ?(?:,|/|or) ?(?:an? )?(?:ms|ma|master)|(?:qualification|requirement).{0,2000}\b(?:master|ms degree|m\.s\.)")
CPT_OPT = Check("cpt/opt", "cpt|opt", [r"\b(?:no|not|cannot|can't|unable to|don't|won't|does not|do not|will not)\b[^.;]{0,40}\b(?:cpt|opt)\b(?! ?(?:in|out)\b)", r"\b(?:cpt|opt)\b[^.;]{0,30}\b(?:not (?:accepted|supported|eligible|available|allowed)|ineligible)"], lifted=r"(?<!not )\b(?:support|welcome|provide|offer)s? (?:cpt|opt)\b|\b(?:cpt|opt) (?:is |are )?(?:eligible|accepted|welcome)", around=150)
US_PERSON = Check("us person", "person|dod contract|department of defen|export control", [rf"\b{_US} persons?\b", r"\bdod contract", r"\bdepartment of defen[sc]e\b", r"\bsubject to export control\b"], lifted=r"export control (?:policy|training)|export compliance", around=300)
DEGREE_STRICT = Check("bachelor only", "bachelor|undergraduate", [r"\bbachelor'?s? (?:degree|degrees) only\b", r"\bopen (?:only )?to (?:current )?undergraduate", r"\bfor undergraduates?\b"], lifted=_GRADUATES, around=300)

_LISTED = r"\b(?:preferred|desired) (?:degrees?|majors?|disciplines?|fields? of study)(?: (?:include|are|is))? ?:? ?([^.;]{3,150})"
_ENROLLED = r"\b(?:enrolled|studying|students?)(?: currently)?(?: at| in)(?: an?| any)?(?: accredited| local)? (?:university|college|school|institution|universities|colleges|schools)(?: located| based)? (?:in|within) (?:the )?(?:(?:state|province|greater) (?:of )?)?([a-z][a-z .\-]{1,30})"
_HOME = r"united states|\bu\.?s\b|\busa\b|massachusetts|boston|new england"
_AT_HOME = r"\b(?:university|college|school)(?: or (?:university|college))? in the (?:united states|u\.?s)\b|enrolled in an accredited"


def preferred_elsewhere(low: Column) -> Column:
    """A list of preferred degrees names other fields of engineering and none of computing."""
    return mentions(low, "preferred|desired") & F.exists(F.regexp_extract_all(low, F.lit(_LISTED), F.lit(1)), lambda l: l.rlike(_OTHER_FIELD) & ~l.rlike(_COMPUTING))


def enrolled_elsewhere(low: Column) -> Column:
    """Students of schools in a named state, province, country or metropolitan area, unless that is at home."""
    known = r"\b(?:" + "|".join([*STATES, *PROVINCES, *ABROAD, "uk", "bay area", "tri-state", "metro"]) + r")\b"
    places = F.regexp_extract_all(low, F.lit(_ENROLLED), F.lit(1))
    return mentions(low, "enrolled|studying|student") & F.exists(places, lambda p: p.rlike(known) & ~p.rlike(_HOME)) & ~low.rlike(_AT_HOME)


def graduation_year(low: Column, latest: int = 2027) -> Column:
    """True if years of graduation are named and all are after `latest`; a range that holds it, 'or later' and days of
    the calendar don't count."""
    days = r"(?=[adfjmnos])\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{1,2},? \d{4}\b"

    def late(text: Column) -> Column:
        named = F.regexp_extract_all(text, F.lit(r"(?:graduat\w*[^.0-9]{0,40}|class of )(20[23]\d)"), F.lit(1))
        second = F.regexp_extract_all(text, F.lit(r"graduat\w*[^.0-9]{0,40}20[23]\d ?(?:-|,|/|to|and|or)(?: [a-z]+)? ?(20[23]\d)"), F.lit(1))
        ranges = F.regexp_extract_all(text, F.lit(r"(20[23]\d ?(?:-|to|and) ?(?:[a-z]+ )?20[23]\d)[^.]{0,30}(?:graduat|class)"), F.lit(1))
        years = F.transform(F.flatten(F.array(named, second, F.transform(ranges, lambda r: F.substring(r, 1, 4)))), lambda y: y.cast("int"))
        return _bound(F.array_min(years), lambda first: first.isNotNull() & (first > latest)) & ~text.rlike(r"graduat\w*[^.]{0,60}(?:or later|and beyond|or after)")

    def told(low: Column) -> Column:
        held = F.when(mentions(low, "graduat|class of"), low)  # null for most texts, which costs nothing further on
        return F.when(low.isNotNull(), F.coalesce(_bound(F.regexp_replace(held, days, " "), late), F.lit(False)))

    return _bound(low, told)


def squeezed(page: Column) -> Column:
    return F.regexp_replace(F.lower(page), r"\s+", " ")


def _on(page: Column, what) -> Column:
    """what(text in lower case): bound to a variable, so that it is made once for all checks."""
    return _bound(squeezed(page), what)


def checks(low: Column, latest: int = 2027) -> list[tuple[str, Column]]:
    """(reason, condition) of all fourteen checks, in order."""
    one = lambda c: (c.reason, c.holds(low))
    return [
        one(CLEARANCE), one(CITIZENSHIP), one(GRADUATE_BY), one(PERMANENT), one(HIGH_SCHOOL), one(UNDERGRADUATE), one(OTHER_DEGREE), ("preferred degree", preferred_elsewhere(low)), one(PHD),
        ("enrolled elsewhere", enrolled_elsewhere(low)), one(CPT_OPT), one(US_PERSON), one(DEGREE_STRICT), ("graduation year", graduation_year(low, latest)),
    ]


def restriction(page: Column, latest: int = 2027) -> Column:
    """Reason of the first check that holds, or null; a null page has none."""
    return _on(page, lambda low: F.coalesce(*[F.when(test, reason) for reason, test in checks(low, latest)]))


def matched_passage(page: Column) -> Column:
    """What a rejection is logged with: the passage of the first worded check that occurs, '' if none."""
    worded = [CLEARANCE, CITIZENSHIP, GRADUATE_BY, PERMANENT, HIGH_SCHOOL, UNDERGRADUATE, OTHER_DEGREE, PHD, CPT_OPT, US_PERSON, DEGREE_STRICT]
    return _on(page, lambda low: F.coalesce(*[F.when(c.holds(low), c.passage(low)) for c in worded], F.lit("")))


def sponsorship(page: Column, learned: Column | None = None) -> Column:
    """What is learned of the company, if that is Yes or No; else Yes if sponsoring is offered, then No if it is refused
    or merely named as (not) available; else Unknown."""
    low = F.when(F.contains(F.lower(page), F.lit("sponsor")), squeezed(page))  # every wording holds it
    yes = low.rlike(r"(?<!not |n't |to )\b(?:will|does|can|provides?)(?: visa| h-?1b)? sponsor(?!\w* ?not)|h-?1b\b[^.]{0,60}\bsponsor|\bsponsor\w*\b[^.]{0,60}\bh-?1b")
    no = low.rlike(r"\b(?:no|not|cannot|can't|doesn't|won't|unable to|without)(?: (?:provide|offer|able to|be able to|take over))*(?: (?:visa|employment|work))* sponsor|\bsponsorship (?:is )?(?:not )?available")
    told = F.when(yes, "Yes").when(no, "No").otherwise("Unknown")
    return told if learned is None else F.when(learned.isin("Yes", "No"), learned).otherwise(told)
