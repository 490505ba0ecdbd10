"""Small dimension values. All are fixed values: they must equal what documents and records use."""

# Genitive Polish and English month names, as dates in contracts spell them.
MONTHS_PL = "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia".split()
MONTHS_EN = "january february march april may june july august september october november december".split()
# Folded month names of the wider grammar, by language.
MONTHS_FR = "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre".split()
MONTHS_NL = "januari februari maart april mei juni juli augustus september oktober november december".split()
MONTHS_DE = "januar februar marz april mai juni juli august september oktober november dezember".split()
# Languages by decimal separator.
COMMA_LANGUAGES = "pl de cs sk fr es it nl pt ru uk lt lv et sv da no nb fi hu ro bg hr sl sr tr el id".split()
POINT_LANGUAGES = "en ja zh ko he th hi ms".split()
# Words after a number that multiply it.
MULTIPLIERS = {
    "tys": 1_000, "tysiąc": 1_000, "tysięcy": 1_000, "thousand": 1_000, "k": 1_000,
    "mln": 1_000_000, "milion": 1_000_000, "miliona": 1_000_000, "milionów": 1_000_000, "million": 1_000_000,
    "mld": 1_000_000_000, "miliard": 1_000_000_000, "miliardów": 1_000_000_000, "billion": 1_000_000_000,
}
# Those that may stand between an amount and its currency.
MONEY_MULTIPLIERS = {"tys": 1_000, "tys.": 1_000, "thousand": 1_000, "mln": 1_000_000, "million": 1_000_000, "mld": 1_000_000_000, "billion": 1_000_000_000}
# Currency words and signs.
CURRENCY_WORDS = {
    "zł": "PLN", "zl": "PLN", "złotych": "PLN", "złote": "PLN", "złoty": "PLN", "pln": "PLN",
    "eur": "EUR", "euro": "EUR", "€": "EUR", "usd": "USD", "us$": "USD", "$": "USD", "dolarów": "USD",
    "gbp": "GBP", "£": "GBP", "chf": "CHF",
}
# Currency symbols and document type names that records may use.
CURRENCY_ALIASES = {"zł": "PLN", "zl": "PLN", "€": "EUR", "$": "USD", "£": "GBP", "euro": "EUR"}
TYPE_ALIASES = {"invoice": "faktura", "contract": "umowa", "agreement": "umowa", "offer": "oferta", "report": "raport", "other": "inne"}
DOCUMENT_TYPES = ("faktura", "umowa", "oferta", "raport", "inne")
# The codes of ISO 4217, by letter.
CURRENCIES = (
    "AED AFN ALL AMD AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BOV BRL BSD BTN BWP BYN BZD CAD CDF CHE CHF CHW CLF CLP CNY COP COU CRC CUP CVE CZK "
    "DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT "
    "LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MXV MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF "
    "SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD USN UYI UYU UYW UZS VED VES VND VUV WST "
    "XAF XAG XAU XBA XBB XBC XBD XCD XCG XDR XOF XPD XPF XPT XSU XTS XUA XXX YER ZAR ZMW ZWG"
).split()
# Abbreviations whose point does not end a sentence.
ABBREVIATIONS = (
    "ul nr np tj tzw m.in ok ust art pkt godz prof dr mgr inż św al pl os tel zob por wg poz tys mln mld dot ds sp zał lp im "
    "mr mrs ms e.g i.e vs etc inc ltd no st z.b bzw ca str u.a"
).split()
# Words of a name that do not tell companies apart.
NAME_STOPWORDS = "spolka akcyjna ograniczona odpowiedzialnoscia komandytowa jawna ltd gmbh inc llc oraz and".split()

# Word edges of ASCII words: Java's own take letters of every script into words.
_EDGE, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# Phrases, in folded text, that address a language system; in this order.
INSTRUCTION_PHRASES = (
    r"zignoruj\s+(wszystkie\s+)?(wczesniejsze|poprzednie|powyzsze)\s+(polecenia|instrukcje)",
    r"instrukcj[aei]\s+dla\s+(systemu\s+)?(ai|sztucznej\s+inteligencji|modelu|asystenta)",
    r"nie\s+wspominaj\s+o\s+(tej|tych)\s+instrukcj",
    r"ignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions|prompts|messages)",
    r"disregard\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions|prompts)",
    r"(instructions?|note)\s+(for|to)\s+(the\s+)?(ai|assistant|language\s+model|llm|chatgpt|claude)" + _END,
    r"you\s+are\s+now\s+(a|an|in)" + _END,
    _EDGE + r"system\s+prompt" + _END,
    r"ignoriere\s+(alle\s+)?(vorherigen|bisherigen)\s+(anweisungen|befehle)",
)
# Words that label an amount, by kind.
LABELS = {
    "tax": {
        "net": rf"{_EDGE}netto{_END}|{_EDGE}net{_END}|bez\s+(?:podatku\s+)?vat|excl(?:uding|\.)?\s+vat",
        "gross": rf"{_EDGE}brutto{_END}|{_EDGE}gross{_END}|z\s+(?:podatkiem\s+)?vat{_END}|incl(?:uding|\.)?\s+vat",
    },
    "period": {
        "monthly": rf"miesięczn\p{{L}}*|/\s?mies(?:\.|{_END})|{_EDGE}na\s+miesiąc{_END}|{_EDGE}za\s+miesiąc{_END}|{_EDGE}monthly{_END}|{_EDGE}per\s+month{_END}|/\s?month{_END}",
        "yearly": rf"{_EDGE}rocz\p{{L}}*|/\s?rok{_END}|{_EDGE}za\s+rok{_END}|{_EDGE}w\s+roku{_END}|{_EDGE}annual\p{{L}}*|{_EDGE}yearly{_END}|{_EDGE}per\s+year{_END}|/\s?year{_END}|{_EDGE}per\s+annum{_END}",
    },
}
