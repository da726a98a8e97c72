"""Location functions as columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnmill.functions.text import squeeze

_CODES = (
    "AK Alaska|AL Alabama|AR Arkansas|AZ Arizona|CA California|CO Colorado|CT Connecticut|DC District of Columbia|DE Delaware|FL Florida|GA Georgia|GU Guam|HI Hawaii|IA Iowa|ID Idaho|IL Illinois|IN Indiana|KS Kansas|KY Kentucky"
    "|LA Louisiana|MA Massachusetts|MD Maryland|ME Maine|MI Michigan|MN Minnesota|MO Missouri|MS Mississippi|MT Montana|NC North Carolina|ND North Dakota|NE Nebraska|NH New Hampshire|NJ New Jersey|NM New Mexico|NV Nevada|NY New York"
    "|OH Ohio|OK Oklahoma|OR Oregon|PA Pennsylvania|PR Puerto Rico|RI Rhode Island|SC South Carolina|SD South Dakota|TN Tennessee|TX Texas|UT Utah|VA Virginia|VI Virgin Islands|VT Vermont|WA Washington|WI Wisconsin|WV West Virginia|WY Wyoming"
)
#: State or territory in lower case -> code.
STATES = {name.lower(): code for code, name in (x.split(" ", 1) for x in _CODES.split("|"))}
#: Province in lower case -> code.
PROVINCES = {name.lower(): code for code, name in (x.split(" ", 1) for x in "AB Alberta|BC British Columbia|MB Manitoba|NB New Brunswick|NL Newfoundland|NS Nova Scotia|NT Northwest Territories|NU Nunavut|ON Ontario|PE Prince Edward Island|QC Quebec|SK Saskatchewan|YT Yukon".split("|"))}
#: Country -> words for it besides its name: large cities first of all.
COUNTRIES = {
    "argentina": "buenos aires", "australia": "sydney melbourne brisbane perth canberra adelaide", "austria": "vienna graz", "bangladesh": "dhaka", "belgium": "brussels antwerp ghent", "brazil": "sao_paulo são_paulo rio_de_janeiro",
    "bulgaria": "sofia", "canada": "toronto montreal ottawa calgary edmonton winnipeg mississauga waterloo_on", "chile": "santiago", "china": "beijing shanghai shenzhen hangzhou guangzhou prc", "colombia": "bogota medellin", "costa rica": "san_jose_cr",
    "croatia": "zagreb", "czech republic": "prague brno czechia", "denmark": "copenhagen aarhus", "egypt": "cairo", "estonia": "tallinn", "finland": "helsinki espoo", "france": "paris lyon toulouse grenoble", "germany": "berlin munich münchen hamburg frankfurt stuttgart cologne köln düsseldorf deutschland",
    "greece": "athens_greece thessaloniki", "hong kong": "kowloon", "hungary": "budapest", "india": "bangalore bengaluru hyderabad mumbai pune chennai delhi gurgaon noida kolkata", "indonesia": "jakarta", "ireland": "dublin cork galway", "israel": "tel_aviv haifa jerusalem herzliya", "italy": "milan rome turin bologna",
    "japan": "tokyo osaka kyoto", "kenya": "nairobi", "latvia": "riga", "lithuania": "vilnius", "luxembourg": "", "malaysia": "kuala_lumpur penang", "mexico": "guadalajara monterrey mexico_city", "netherlands": "amsterdam rotterdam eindhoven utrecht", "new zealand": "auckland wellington", "nigeria": "lagos",
    "norway": "oslo bergen", "pakistan": "karachi lahore islamabad", "peru": "lima_peru", "philippines": "manila cebu", "poland": "warsaw krakow kraków wroclaw wrocław gdansk gdańsk", "portugal": "lisbon porto", "romania": "bucharest cluj", "saudi arabia": "riyadh", "serbia": "belgrade", "singapore": "", "slovakia": "bratislava",
    "south africa": "johannesburg cape_town", "south korea": "seoul korea", "spain": "madrid barcelona valencia", "sri lanka": "colombo", "sweden": "stockholm gothenburg malmö", "switzerland": "zurich zürich geneva lausanne basel", "taiwan": "taipei hsinchu", "thailand": "bangkok", "turkey": "istanbul ankara",
    "ukraine": "kyiv lviv", "united arab emirates": "dubai abu_dhabi", "united kingdom": "london manchester edinburgh birmingham_uk cambridge_uk oxford glasgow bristol leeds england scotland wales uk", "vietnam": "hanoi ho_chi_minh",
}
ABROAD = sorted(COUNTRIES)
#: Cities that are abroad whatever state code follows (a country's code that is a state's too: DE, IN).
FIRM = "munich münchen berlin hamburg frankfurt stuttgart cologne köln düsseldorf hyderabad bangalore bengaluru mumbai pune chennai delhi gurgaon noida toronto montreal ottawa calgary tokyo"
CITIES = (
    "new york|san francisco|palo alto|mountain view|sunnyvale|san jose|santa clara|los angeles|seattle|austin|boston|chicago|denver|atlanta|dallas|houston|phoenix|portland|san diego|pittsburgh|raleigh|charlotte|nashville|minneapolis|detroit"
    "|philadelphia|baltimore|columbus|indianapolis|salt lake city|irvine|bellevue|redmond|cupertino|menlo park|miami|tampa|orlando|las vegas|kansas city|st. louis|cleveland|cincinnati|milwaukee|sacramento"
)
CITY_SHORT = {"sf": "San Francisco", "nyc": "New York", "la": "Los Angeles", "dc": "Washington", "philly": "Philadelphia", "vegas": "Las Vegas"}
SITES = {".co.uk": "united kingdom", "/uk/": "united kingdom", ".ca/": "canada", "/canada/": "canada", ".de/": "germany", "/germany/": "germany", ".fr/": "france", ".co.in": "india", "/india/": "india", ".com.au": "australia", ".ie/": "ireland", ".sg/": "singapore"}


def _any(words) -> str:
    """Pattern of any of the words, the longest first, as words of their own."""
    return r"(?<![\p{L}\d])(?:" + "|".join(sorted((w.replace("_", " ").replace(".", r"\.") for w in words), key=len, reverse=True)) + r")(?![\p{L}\d])"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(pairs.items())))


_WORDS = {w.replace("_", " "): country for country, more in COUNTRIES.items() for w in [country, *(x for x in more.split() if not x.endswith(("_uk", "_on", "_cr", "_greece", "_peru")))]} | {"buenos aires": "argentina"}
_WORDS.pop("buenos", None)
_WORDS.pop("aires", None)


def state(x: Column) -> Column:
    """Two capitals after the first comma that has such; '' if none."""
    return F.coalesce(F.regexp_extract(x, r",\s*([A-Z][A-Z])\b", 1), F.lit(""))


def state_code(x: Column) -> Column:
    """Code of a US state or territory: two capitals after a comma that are one, or else its name; '' if none."""
    codes = F.filter(F.regexp_extract_all(x, F.lit(r"(?:,\s*|^US-|^)([A-Z]{2})(?=\b)"), F.lit(1)), lambda c: c.isin(list(STATES.values())))
    named = F.try_element_at(_map(STATES), F.regexp_extract(F.lower(x), _any(STATES), 0))
    return F.coalesce(F.get(codes, 0), named, F.lit(""))


def state_bucket(x: Column) -> Column:
    low = F.lower(F.coalesce(x, F.lit("")))
    named = F.coalesce(F.try_element_at(_map(STATES), F.regexp_extract(low, _any(STATES), 0)), F.lit("Unknown"))
    return F.when(low.isin("", "unknown"), "Unknown").when(F.contains(low, F.lit("remote")), "Remote").when(F.contains(low, F.lit("hybrid")), "Hybrid").when(state(x) != "", state(x)).otherwise(named)


def standardize(x: Column) -> Column:
    """'ST-City' and 'City. ST' as 'City, ST'; state names as codes, short city names in full."""
    c = squeeze(F.regexp_replace(x, r"(?i)^(location|based in)\s*[:-]?\s*", ""))
    c = F.regexp_replace(c, r"^(?:US-)?([A-Z]{2})-([A-Z][A-Za-z ]+)$", "$2, $1")
    c = F.regexp_replace(c, r"\s*[.]\s+([A-Z]{2})$", ", $1")
    name = F.lower(F.trim(F.regexp_extract(c, r",([^,]+)$", 1)))
    code = F.try_element_at(_map(STATES), name)
    c = F.when(code.isNotNull(), F.concat(F.regexp_replace(c, r"\s*,[^,]+$", ""), F.lit(", "), code)).otherwise(c)
    return F.coalesce(F.try_element_at(_map(CITY_SHORT), F.lower(c)), c)


def in_us(place: Column) -> Column:
    """Whether a place is in the US as far as it says: unknown places are, foreign words aren't, and then a state, a US
    word or a known city is needed."""
    low = F.lower(F.trim(F.coalesce(place, F.lit(""))))
    abroad_ = low.rlike(_any(_WORDS)) | low.rlike(_any(PROVINCES)) | place.rlike(r",\s*(?:" + "|".join(sorted(PROVINCES.values())) + r")\b")
    firm = low.rlike(_any(FIRM.split())) | low.rlike(_any(ABROAD))
    home = low.rlike(r"remote|usa|united states|\bus-") | (state_code(place) != "") | low.rlike(_any(CITIES.split("|")))
    return F.when(low.isin("", "unknown"), True).when(firm, False).when(abroad_ & (state_code(place) == ""), False).otherwise(home)


def abroad(place: Column, title: Column, url: Column | None = None, page: Column | None = None) -> Column:
    """Reason why a posting is abroad, or null: a country in the title, a site of a country, then the place: its words,
    provinces and cities, then a page that speaks of Canada more than of the US. A US state outweighs what is said of the
    place, save for the few cities that are firm, and the page."""
    low, t = F.lower(F.coalesce(place, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    found = lambda x, words: F.nullif(F.regexp_extract(x, _any(words), 0), F.lit(""))
    home = state_code(F.coalesce(place, F.lit(""))) != ""
    by_title = F.concat(F.lit("title: "), found(t, ABROAD))
    by_url = F.lit(None).cast("string")
    if url is not None:
        u = F.lower(F.concat(url, F.lit("/")))
        by_url = F.coalesce(*[F.when(F.contains(u, F.lit(s)), f"url: {c}") for s, c in SITES.items()])
    firm = F.concat(F.lit("place: "), F.try_element_at(_map(_WORDS), found(low, FIRM.split())))
    country = F.concat(F.lit("place: "), found(low, ABROAD))
    province = F.coalesce(found(low, PROVINCES), F.nullif(F.regexp_extract(place, r"(?:,\s*|\s)(" + "|".join(sorted(PROVINCES.values())) + r"|CAN)$", 1), F.lit("")))
    word = F.concat(F.lit("place: "), F.try_element_at(_map(_WORDS), found(low, _WORDS)))
    by_place = F.coalesce(firm, F.when(~home, F.coalesce(country, F.when(province.isNotNull(), "place: canada"), word)))
    by_page = F.lit(None).cast("string")
    if page is not None:
        p = F.lower(page)
        n = lambda r: F.regexp_count(p, F.lit(r))
        by_page = F.when(~home & (n(r"\bcanad(?:a|ian)\b|\bontario\b|\bquebec\b|\bcad\b") > n(r"\bunited states\b|\busa\b|\bu\.s\.|\busd\b")), "page: canada")
    return F.coalesce(by_title, by_url, by_place, by_page)


def garbage(x: Column) -> Column:
    return F.coalesce((F.length(x) > 100) | x.rlike(r"^\s*,") | x.rlike(r"^[A-Z]{2}$") | x.rlike(r"\d{3}") | F.lower(x).rlike("click|apply|http"), F.lit(True))


def pick_first(x: Column) -> Column:
    """First 'City, ST' of a list of places, else the first part."""
    pairs = F.regexp_extract_all(x, F.lit(r"([A-Z][A-Za-z .]+, [A-Z]{2})\b"), F.lit(1))
    return F.when(F.size(pairs) > 0, F.trim(F.try_element_at(pairs, F.lit(1)))).otherwise(F.trim(F.substring_index(x, ";", 1)))
