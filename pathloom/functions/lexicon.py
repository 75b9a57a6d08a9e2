"""Patterns and word lists that decide how values are typed.

Patterns are written for Java: ``\\z`` instead of ``$``, ASCII classes spelled out.
"""

from __future__ import annotations

# Patterns of value types.
FLOAT = r"^-?[0-9]+\.[0-9]+\z"
ISO_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?(\.[0-9]+)?(Z|[+\-][0-9]{2}:?[0-9]{2})?\z"
HASH = r"^[0-9a-fA-F]{32,}\z"
SLUG = r"^[a-z0-9]+(?:[-_][a-z0-9]+)+\z"
LITERAL = r"^\p{L}[\p{L}\p{M}_]*\z"
OPAQUE = r"^[A-Za-z0-9_\-.~]{4,}\z"
IPV6_FULL = r"^[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){7}\z"
IPV6_COMPRESSED = r"^[0-9a-fA-F:]{2,}\z"
URL = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^ \t\r\n\u000B\u000C]+\z"
SCHEMELESS_URL = r"^[a-zA-Z0-9\-]+(?:\.[a-zA-Z0-9\-]+)*\.[a-zA-Z]{2,}/[^ \t\r\n\u000B\u000C]*\z"
EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+\z"
BOOLEAN = r"^(?iu:true|false)\z"
VERSION = r"^v[0-9]+(?:\.[0-9]+)*(?:[-+][A-Za-z0-9.\-]+)?\z"
LOCALE = r"^([a-z]{2,3})[-_]([A-Za-z0-9]{2,4})\z"
LOCALE_BARE = r"^[a-z]{2}\z"
CURRENCY = r"^[A-Za-z]{3}\z"
PHONE = r"^\+[ \-.()0-9]{7,20}\z"
PHONE_NANP = r"^\(?([2-9][0-9]{2})\)?[ \-.]?([2-9][0-9]{2})[ \-.]?([0-9]{4})\z"
FILE = r"^[A-Za-z0-9][A-Za-z0-9_\-.~]*\.([A-Za-z0-9]{1,8})\z"
COLOR_HEX = r"^#([0-9a-fA-F]{3}|[0-9a-fA-F]{4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})\z"
COORDINATE = r"^(-?[0-9]+(?:\.[0-9]+)?),(-?[0-9]+(?:\.[0-9]+)?)\z"
COUNTRY = r"^[A-Z]{2}\z"
BASE64 = r"^[A-Za-z0-9+/]{16,}={0,2}\z"
JWT = r"^ey[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\z"
MIME = r"^(?:text|image|video|audio|application|multipart|message|font|model)/[A-Za-z0-9!#$&^_+\-.]+\z"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
INTEGER = r"^[0-9]+\z"
COMPACT_DATE = r"^([0-9]{4})([0-9]{2})([0-9]{2})\z"
DATE_ISO = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})\z"
DATE_SLASH = r"^([0-9]{4})/([0-9]{2})/([0-9]{2})\z"
DATE_US = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\z"
FILE_EXT = r"\.([A-Za-z0-9]{1,8})\z"
IPV4 = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\z"

# Country codes.
COUNTRIES = """
    AD AE AF AG AL AM AO AR AT AU AZ BA BB BD BE BG BH BJ BM BN BO BR BS BT BW BY BZ CA CD CG CH CI CL CM CN
    CO CR CU CY CZ DE DJ DK DM DO DZ EC EE EG ER ES ET FI FJ FK FM FO FR GA GB GE GH GI GL GM GN GR GT GU GW
    GY HK HN HR HT HU ID IE IL IM IN IQ IR IS IT JM JO JP KE KG KH KM KN KP KR KW KY KZ LA LB LC LI LK LR LS
    LT LU LV LY MA MC MD ME MG MK ML MM MN MO MR MT MU MV MW MX MY MZ NA NE NG NI NL NO NP NR NU NZ OM PA PE
    PF PG PH PK PL PR PT PW PY QA RE RO RS RU RW SA SB SC SD SE SG SI SK SL SM SN SO SR SS ST SV SY SZ TD TG
    TH TJ TM TN TO TR TT TV TW TZ UA UG US UY UZ VA VC VE VG VI VN VU WS YE ZA ZM ZW
""".split()

# Language codes of locales.
LANGUAGES = """
    ar bg bn ca cs da de el en es et fa fi fr gu he hi hr hu id it ja ka kk km kn ko lt lv mk ml mr ms my nb
    nl no pa pl pt ro ru sk sl sr sv sw ta te th tl tr uk ur vi zh
""".split()

# Currency codes.
CURRENCIES = """
    USD EUR GBP JPY CNY CHF CAD AUD NZD HKD SGD INR KRW MXN BRL ZAR SEK NOK DKK PLN CZK HUF RUB TRY ILS AED
    SAR THB IDR PHP VND TWD MYR NGN EGP
""".split()

# Public suffixes of two labels.
TWO_LABEL_SUFFIXES = """
    co.uk org.uk gov.uk ac.uk net.uk me.uk ltd.uk plc.uk sch.uk co.jp ac.jp or.jp ne.jp go.jp gr.jp ed.jp
    lg.jp com.au net.au org.au edu.au gov.au asn.au id.au co.nz net.nz org.nz govt.nz ac.nz school.nz com.br
    net.br org.br gov.br edu.br com.cn net.cn org.cn gov.cn edu.cn ac.cn co.za net.za org.za gov.za ac.za
    co.kr ne.kr or.kr re.kr go.kr ac.kr co.in net.in org.in gov.in ac.in co.il net.il org.il gov.il ac.il
    muni.il com.mx net.mx org.mx gob.mx edu.mx com.ar net.ar org.ar gov.ar com.hk net.hk org.hk gov.hk
    edu.hk com.tw net.tw org.tw gov.tw edu.tw com.sg net.sg org.sg gov.sg edu.sg per.sg com.tr net.tr org.tr
    gov.tr edu.tr k12.tr
""".split()

# File extensions by kind.
FILE_KINDS = {
    "image": "png jpg jpeg gif webp svg bmp tiff tif ico avif heic heif".split(),
    "document": "pdf doc docx xls xlsx ppt pptx odt ods odp rtf epub".split(),
    "data": "csv tsv json xml yaml yml parquet sqlite db ndjson jsonl".split(),
    "text": "txt md log markdown rst".split(),
    "web": "html htm css js mjs cjs ts jsx tsx map".split(),
    "font": "woff woff2 ttf otf eot".split(),
    "audio": "mp3 wav ogg flac aac m4a opus".split(),
    "video": "mp4 mov avi mkv webm flv wmv m4v m3u8".split(),
    "archive": "zip tar gz bz2 7z rar xz tgz".split(),
    "code": "rb py go java c cc cpp h hpp sh swift kt rs".split(),
}

# Parameter names by the type they suggest.
NAME_HINTS = {
    "phone": "phone tel telephone mobile cell".split(),
    "email": "email e_mail mail".split(),
    "locale": "locale lang language".split(),
    "currency": "currency cur curr".split(),
    "url": "url uri redirect redirect_url return_to return_url callback callback_url next_url".split(),
    "jwt": "jwt bearer auth_token".split(),
    "mime": "mime content_type media_type".split(),
    "color": "color colour bg background fg foreground".split(),
    "coordinate": "coords coordinates geo location position latlng latlon".split(),
    "country": "country country_code nation".split(),
}

# Irregular singulars.
IRREGULAR = {
    "people": "person",
    "children": "child",
    "men": "man",
    "women": "woman",
    "mice": "mouse",
    "geese": "goose",
    "oxen": "ox",
    "feet": "foot",
    "teeth": "tooth",
    "lives": "life",
    "wives": "wife",
    "moves": "move",
    "zombies": "zombie",
    "indices": "index",
    "vertices": "vertex",
    "leaves": "leaf",
    "calves": "calf",
    "halves": "half",
    "loaves": "loaf",
    "hooves": "hoof",
}

# Words without a plural form.
UNCOUNTABLE = "news fish sheep deer series species equipment information money rice jeans police data media".split()

# Singular rules in order; the first that matches replaces once.
SINGULAR_RULES = [
    (r"(?iu)(quiz)zes\z", "$1"),
    (r"(?iu)(matri|appendi)ces\z", "$1x"),
    (r"(?iu)(ox)en\z", "$1"),
    (r"(?iu)(alias|status)(es)?\z", "$1"),
    (r"(?iu)(octop|vir)(us|i)\z", "$1us"),
    (r"(?iu)(cris|ax|test)es\z", "$1is"),
    (r"(?iu)(shoe)s\z", "$1"),
    (r"(?iu)(bus)(es)?\z", "$1"),
    (r"(?iu)([ml])ice\z", "$1ouse"),
    (r"(?iu)(x|ch|ss|sh)es\z", "$1"),
    (r"(?iu)(m)ovies\z", "$1ovie"),
    (r"(?iu)(s)eries\z", "$1eries"),
    (r"(?iu)([^aeiouy]|qu)ies\z", "$1y"),
    (r"(?iu)([lr])ves\z", "$1f"),
    (r"(?iu)(tive)s\z", "$1"),
    (r"(?iu)(hive)s\z", "$1"),
    (r"(?iu)([^f])ves\z", "$1fe"),
    (r"(?iu)((a)naly|(b)a|(d)iagno|(p)arenthe|(p)rogno|(s)ynop|(t)he)ses\z", "$1sis"),
    (r"(?iu)([ti])a\z", "$1um"),
    (r"(?iu)(n)ews\z", "$1ews"),
    (r"(?iu)(o)es\z", "$1"),
    (r"(?iu)(ss)\z", "$1"),
    (r"(?iu)s\z", ""),
]

# Default ports by scheme.
DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}

# Schemes, top-level domains and boundary characters of the extractor.
EXTRACT_SCHEMES = "https http ftp wss ws".split()
EXTRACT_TLDS = "com org net io ai dev co app gov edu".split()
EXTRACT_BOUNDARIES = "<>\"',`" + "」』）】〉》〕〗〙〛｠｝］＞「『（【〈《〔〖〘〚｟｛［＜“”‘’„‟‚«»‹›"
EXTRACT_TRAILING = ".,;:!?'\"‘’“”"

# Thresholds of inference.
MIN_OBSERVATIONS = 5
VALUE_CAP = 5000
EXAMPLE_CAP = 10
STABLE_TYPES = "version locale currency boolean slug opaque_id".split()
HINTED_TYPES = "integer uuid hash opaque_id slug".split()
BUILT_IN_TYPES = """
    literal integer float number uuid date timestamp hash slug opaque_id ipv4 ipv6 url email mime coordinate version
    boolean locale phone currency country base64 file color jwt year http_status enum string
""".split()
