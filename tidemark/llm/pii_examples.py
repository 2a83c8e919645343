"""Generated sentences with marked segments, on which the segment model is trained.

Offices, clinics, deliveries and the like: none of the sentences is taken from a table the
operators run on, and the tests measure on other sentences and other names.
"""

from __future__ import annotations

import random

from tidemark.llm.pii_words import FAMILY, GIVEN, PAIRS, PLACES

Example = tuple[str, set[tuple[int, int, str]]]

STREETS = ["Maple", "Oak", "Elm", "High", "Market", "Castle", "King's", "St John's", "Saint Ann's", "Chestnut", "Washington", "Sunset", "Cedar Creek", "Long Acre", "River", "Orchard", "Spring", "Martin Luther King", "Fifth", "Cherry", "Old Kent", "Pine", "Windmill"]
WAYS = ["Street", "St", "St.", "Road", "Rd", "Rd.", "Lane", "Ln", "Avenue", "Ave", "Ave.", "Close", "Crescent", "Terrace", "Way", "Drive", "Dr", "Place", "Court", "Boulevard", "Blvd", "Gardens", "Square"]
TOWNS = ["Bath", "Exeter", "Durham", "Lincoln", "Hereford", "Stirling", "Swansea", "Truro", "Ripon", "Wells Green", "Kirkby Stone", "Aldermoor", "Penbury", "Thistleford", "Sheldwick", "Harbledown", "Wexcombe"]
TOWNS_US = [("Springfield", "IL"), ("Salem", "OR"), ("Dayton", "OH"), ("Santa Rosa", "CA"), ("Albany", "NY"), ("Tulsa", "OK"), ("Mobile", "AL"), ("Washington", "DC")]
TOWNS_DE = ["Kassel", "Bremen", "Köln", "Mainz", "Leipzig", "Ulm", "Graz", "Altdorf"]
STREETS_DE = ["Kirch", "Wald", "Rosen", "Goethe", "Schiller", "Markt", "Wiesen", "Post", "Kaiser", "Mozart"]
STREETS_ES = ["de Alcalá", "Serrano", "de la Paz", "Cervantes", "San Pedro", "Goya"]
STREETS_FR = ["de la Gare", "Victor Hugo", "des Fleurs", "du Moulin", "Pasteur", "Saint-Michel"]
STREETS_IT = ["Garibaldi", "Dante", "Roma", "Verdi", "dei Mille"]
TOWNS_ROMANCE = ["Sevilla", "Burgos", "Nantes", "Lille", "Siena", "Parma", "Dijon", "Cádiz"]
HOSTS = ["acme", "northwind", "initech", "brightpath", "gmx", "post", "mail", "home", "uni-bonn", "example", "corp", "city", "webmail", "office", "green-leaf"]
TLDS = ["com", "org", "net", "co.uk", "de", "es", "fr", "io", "edu", "example", "test", "invalid", "info", "ac.uk"]
ROLES = ["info", "office", "billing", "support", "sales", "hello", "contact", "admin", "jobs"]
COMPANIES = ["Acme Holdings", "Blue River Bank", "Green Leaf Ltd", "Oak Valley School", "St Mary's Hospital", "Royal Opera House", "Central Library", "Grand Hotel", "City Council", "Northern Railway", "Golden Gate Bridge", "Liberty Museum", "Albion Foods Ltd"]
FILLER = [
    "The printer on the second floor is out of paper again.", "Please bring two copies and a pen.", "We expect 340 guests between 18:00 and 22:30.", "Invoices are paid within 30 days.",
    "The lift was repaired on 12 March 2021.", "Our bakery opens at seven.", "The boiler runs at 1.5 bar.", "Rain is likely on Tuesday and Wednesday.", "Das Büro ist am Montag geschlossen.", "Die Lieferung kommt um 14 Uhr.",
    "La tienda abre a las nueve.", "El paquete llegará el 3 de mayo.", "Le magasin ferme à midi.", "Growth was 3.7 per cent in 2019 and 4.1 per cent in 2020.", "New York and Los Angeles are far apart.", "Nothing else was in the box.",
    "Die Verwaltung zahlt die Miete am Ersten.", "Das Wetter war gut, der Himmel blieb klar.", "Nach dem Essen ging die Familie an den See.", "Ohne Licht kein Bild, sagt der Fotograf.", "Gegen Abend kam der Regen, das Dach hielt.", "Am Bahnhof fehlte der Zug, die Ansage war leise.", "Eine Tasse ist leer, ein Teller auch.", "Trotz Regen blieb die Stimmung gut.", "En el barrio, la plaza estaba llena.", "Con tres minutos más, el pan se quema.", "Hasta la noche no hubo noticias.", "Warten auf den Bus der Linie 12.",
    "The meeting lasted 90 minutes and ended without a vote.", "Version 2.4.1 fixes 17 bugs.", "Grand Central was crowded on Good Friday.", "Der Garten sah nach dem Regen gut aus.", "Meet at 5 on the way home.", "She ran 10 miles up the hill in the park.",
]


def _coined(r: random.Random, least: int, most: int) -> str:
    """A name in no stock."""
    syllable = lambda: r.choice(["b", "br", "d", "f", "g", "gr", "h", "k", "l", "m", "n", "p", "r", "s", "st", "t", "th", "v", "w", "y", "z", ""]) + r.choice("aeiou") + r.choice(["", "n", "r", "l", "m", "s", "ck", "nd", "tt", "sk"])
    w = "".join(syllable() for _ in range(r.randint(least, most))) + r.choice(["a", "e", "o", "y", "er", "an", "ic", "is", "en", ""])
    return w.capitalize() if len(w) > 2 else w.capitalize() + "ra"


def _digits(r: random.Random, k: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(k))


def _email(r: random.Random, g: str, f: str) -> str:
    local = r.choice([
        f"{g}.{f}", f"{g}_{r.randint(1, 999)}", f"{f}{r.randint(1, 99)}", f"{g}+{r.choice(['news', 'lists', 'x'])}{r.randint(1, 40)}", f"{g[0]}{f}", f"{g[0]}.{f}", f, f"{f}-{g}",
        f"team.{r.choice(ROLES)}{r.randint(1, 99)}", f"{r.choice(ROLES)}{r.randint(1, 99)}", r.choice(ROLES), f"{r.choice(ROLES)}-{r.choice(ROLES)}{r.randint(1, 99)}",
    ])
    at, dot = r.choice([("@", ".")] * 7 + [(" @ ", "."), (" [at] ", " [dot] "), (" at ", " dot "), (" at ", " dot "), (" at ", " dot "), ("(at)", "."), ("[at]", "."), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" {at} ", ".")])
    if at == " at ":
        local = r.choice([f"{g}{r.randint(1, 99)}", f"{g[0]}{f}", f"{g[0]}{f}", local.replace("-", "") if local not in ROLES else f])
    s = local + at + (r.choice(HOSTS) + "." + r.choice(TLDS)).replace(".", dot)
    return s.upper() if r.random() < 0.08 else s


def _phone(r: random.Random) -> str:
    n = lambda k: _digits(r, k)
    return r.choice([
        f"07{n(3)} {n(6)}", f"07{n(9)}", f"07{n(3)} {n(3)} {n(3)}", f"+44 7{n(3)} {n(6)}", f"+44 (0)7{n(3)} {n(6)}", f"0044 7{n(3)} {n(3)} {n(3)}", f"(01{n(3)}) {n(6)}", f"01{n(3)}-{n(3)}-{n(3)}",
        f"01{n(3)} {n(6)}", f"+44.1{n(3)}.{n(6)}", f"020 {n(4)} {n(4)}", f"(020) {n(4)} {n(4)}", f"+49 {n(2)} {n(5)} {n(3)}", f"0{n(2)}/{n(5)}-{n(3)}", f"0{n(3)} / {n(7)}".replace(" / ", "/"), f"+49 (0)89 {n(6)}",
        f"({n(3)}) {n(3)}-{n(4)}", f"({r.randint(201, 989)}) 555-{n(4)}", f"{r.randint(201, 989)}.{n(3)}.{n(4)}", f"{r.randint(201, 989)}-{n(3)}-{n(4)}", f"+1-{r.randint(201, 989)}-{n(3)}-{n(4)}", f"+1 {r.randint(201, 989)} {n(3)} {n(4)}", f"1-800-{n(3)}-{n(4)}",
        f"0049 {n(2)} {n(8)}", f"+34 6{n(2)} {n(3)} {n(3)}", f"+34 9{n(8)}", f"+33 1 {n(2)} {n(2)} {n(2)} {n(2)}", f"01 {n(2)} {n(2)} {n(2)} {n(2)}", f"+39 06 {n(4)} {n(4)}", f"+353 1 {n(3)} {n(4)}", f"+91 {n(5)} {n(5)}", f"+{r.choice(['31', '46', '48', '41'])} {n(2)} {n(3)} {n(2)} {n(2)}",
    ])


def _health(r: random.Random, ok: bool) -> str:
    while True:
        d = [r.randint(1, 9)] + [r.randint(0, 9) for _ in range(8)]
        c = 11 - sum(x * w for x, w in zip(d, range(10, 1, -1), strict=False)) % 11
        if c == 10:
            continue
        last = 0 if c == 11 else c
        if not ok:
            last = (last + r.randint(1, 9)) % 10
        s = "".join(map(str, [*d, last]))
        return r.choice([s, f"{s[:3]} {s[3:6]} {s[6:]}", f"{s[:3]}-{s[3:6]}-{s[6:]}"])


def _nino(r: random.Random) -> str:
    p = "QQ" if r.random() < 0.3 else r.choice("ABCEGHJKLMNOPRSTWXYZ") + r.choice("ABCEGHJKLMNPRSTWXYZ")
    a, b, c, z = _digits(r, 2), _digits(r, 2), _digits(r, 2), r.choice("ABCD")
    s = r.choice([f"{p}{a}{b}{c}{z}", f"{p}-{a}-{b}-{c}-{z}", f"{p} {a} {b} {c} {z}", f"{p} {a}{b}{c} {z}"])
    return s.lower() if r.random() < 0.12 else s


def _identity(r: random.Random) -> str:
    k = r.random()
    if k < 0.4:
        return _nino(r)
    if k < 0.65:
        a = "000" if r.random() < 0.3 else f"{r.randint(1, 899):03d}"
        sep = r.choice("- ")
        return f"{a}{sep}{_digits(r, 2)}{sep}{_digits(r, 4)}"
    return _health(r, True)


def _address(r: random.Random) -> str:
    k = r.random()
    five = f"{r.randint(1000, 99999):05d}"
    num = f"{r.randint(1, 190)}{r.choice(['', '', 'a', 'b', 'C'])}"
    if k < 0.14:
        way = r.choice(["straße", "str.", "weg", "allee", "gasse", "platz"])
        name = r.choice(STREETS_DE)
        return f"{name}{way} {num}, {five} {r.choice(TOWNS_DE)}" if r.random() < 0.8 else f"{name}er Straße {num}, {five} {r.choice(TOWNS_DE)}"
    if k < 0.2:
        return f"{r.choice(['Calle', 'Avenida', 'Plaza', 'C/'])} {r.choice(STREETS_ES)} {num}, {five} {r.choice(TOWNS_ROMANCE)}"
    if k < 0.26:
        return f"{num}{r.choice(['', ',', ' bis'])} {r.choice(['rue', 'avenue', 'boulevard', 'place'])} {r.choice(STREETS_FR)}, {five} {r.choice(TOWNS_ROMANCE)}"
    if k < 0.3:
        return f"Via {r.choice(STREETS_IT)} {num}, {five} {r.choice(TOWNS_ROMANCE)}"
    if k < 0.45:
        town, state = r.choice(TOWNS_US)
        way = f"{r.choice(STREETS)} {r.choice(WAYS)}{r.choice(['', '', ' NW', ' SE'])}"
        return f"{r.randint(1, 9999)} {way}{r.choice([', ', chr(10)])}{town}, {state} {five}{r.choice(['', '', '-' + _digits(r, 4)])}"
    sep = r.choice([", ", ", ", " ", "\n"])
    flat = r.choice(["", "", "", f"Flat {r.randint(1, 30)}, ", f"Unit {r.randint(1, 20)}{r.choice(['', 'B'])} ", f"Apartment {r.randint(1, 60)}, ", f"Suite {r.randint(1, 400)}, ", f"Flat {r.choice('ABC')}\n"])
    street = f"{r.choice(STREETS)} {r.choice(WAYS)}"
    head = f"{flat}{num}{r.choice(['', '', ','])} {street}"
    if k < 0.53:
        s = f"{head}{sep}{r.choice(TOWNS)}"
        s = head + ", " + r.choice(TOWNS)
    else:
        post = f"{r.choice(['BA', 'EX', 'LN', 'TR', 'SW', 'M', 'ZZ', 'QX'])}{r.randint(1, 19)} {r.randint(1, 9)}{r.choice('ABDEFGHJ')}{r.choice('ABDEFGHJ')}"
        if r.random() < 0.2:
            post = post.replace(" ", "").lower()
        s = f"{head}{sep}{r.choice(TOWNS)}{sep if sep == chr(10) else r.choice([', ', ' '])}{post}"
    return s.upper() if r.random() < 0.1 else s


def _name(r: random.Random, g: str, f: str, more_given: list[str], more_family: list[str]) -> str:
    k = r.random()
    if r.random() < 0.1:
        f = f"{f}-{r.choice(more_family)}"
    if k < 0.13:
        s = f"{g} {r.choice('ABCDEHJLMRSTW')}. {f}"
    elif k < 0.26:
        s = f"{f}, {g}"
    elif k < 0.36:
        s = f"{g} {r.choice(more_given)} {f}"
    elif k < 0.43:
        s = f"{g} {r.choice(['de', 'del', 'van', 'von', 'van der', 'di', 'bin', 'da', 'de la'])} {f}"
    elif k < 0.46:
        s = f"{g} {r.choice(more_given)} {r.choice(more_family)} {f}"
    elif k < 0.5:
        s = f"{g} del {r.choice(more_given)} {f}"
    else:
        s = f"{g} {f}"
    if r.random() < 0.05:
        s = s.replace(" ", "\n", 1)
    c = r.random()
    return s.upper() if c < 0.1 else (s.lower() if c < 0.16 and "." not in s else s)


TEMPLATES: list[tuple[str, int]] = [
    # sentences with marked slots, and how often each is used
    ("Our mailbox is {email} and it is read daily.", 3), ("Forward the minutes to {email} please.", 3), ("E-mail: {email}", 3), ("For refunds email {email} or visit the desk.", 3), ("Die Adresse lautet {email} und wird täglich gelesen.", 1), ("Su correo es {email} desde ayer.", 1),
    ("[{email}]", 2), ("({email})", 2), ("Write to {name} ({email}) now.", 2), ("cc: {email}, {email}", 2), ("{email} bounced twice.", 3), ("You reach the clinic via {email} at any hour.", 2), ("My inbox, {email}, is full.", 2), ("Subscribe with {email} today", 2),
    ("Dial {phone} for the night desk.", 3), ("Phone: {phone}", 3), ("Her mobile is {phone} these days.", 3), ("Send a text to {phone} when you arrive.", 3), ("Fax {phone} still works.", 2), ("The pharmacy answers on {phone} until six.", 3), ("Rufen Sie {phone} an.", 1), ("Téléphone : {phone}", 1), ("Su teléfono es {phone} ahora.", 1), ("({phone})", 2), ("Tel. {phone}", 2), ("Tel {phone} or come by.", 2), ("Nobody picks up {phone}, sorry.", 2), ("Just call {phone}!", 2), ("{phone} is engaged all morning.", 2), ("Mobile {phone}, landline {phone}.", 2),
    ("The file lists {identity} for this patient.", 3), ("NI number: {identity}", 3), ("Social security number {identity} was copied wrongly.", 3), ("NHS number {identity}", 3), ("My national insurance no. is {identity} and I pay tax.", 3), ("Identity: {identity}.", 2), ("SSN {identity}; born 1980.", 2), ("Her health number, {identity}, is new.", 2), ("She entered {identity} in the first field.", 5), ("Please confirm {identity} by Monday.", 2), ("Someone wrote {identity} on the envelope.", 5), ("We copied {identity} from the old form.", 5), ("{identity} is what the clerk typed.", 3), ("Signed up with {identity} in June.", 4),
    ("The parcel goes to {address} on Monday.", 4), ("Home address: {address}", 4), ("They moved from {address} last spring.", 4), ("Her flat at {address} is for sale.", 3), ("Billing address:\n{address}\n", 4), ("Return it to {address}, please.", 3), ("Wohnhaft in {address}.", 1), ("Vive en {address}.", 1), ("J'habite au {address}.", 1), ("Our shop ({address}) is closed.", 2),
    ("{name}, {phone}, {email}", 3), ("{name}\n{address}\n{phone}\n", 4), ("Attn: {name}, {address}", 3), ("Name: {name}; Phone: {phone}; Address: {address}", 3), ("From: {name} <{email}>", 4), ("{name} | {email} | {phone}", 3),
    ("Dear {name}, your table is booked.", 3), ("Regards, {name}", 3), ("Dr {name} will see you now.", 3), ("The lease was signed by {name} in April.", 4), ("Mrs {name} paid in cash.", 3), ("I met {name} at the conference.", 4), ("Herr {name} wartet schon.", 2), ("Frau {name} ist im Urlaub.", 1), ("La señora {name} llamó ayer.", 2), ("Madame {name} est absente.", 1), ("{name} resigned last week.", 4), ("We hired {name} and two others.", 4), ("according to {name}, it rained.", 3), ("The letter from {name} arrived late.", 3), ("Patient: {name}", 3), ("Is {name} joining us?", 3), ("The winner is {name}!", 3), ("Ask Mr {name} or Ms {name}.", 2), ("{name} and {name} share an office.", 3), ("Only {name} knew.", 3), ("A photo of {name} was found.", 3), ("We let {name} decide.", 3), ("Unser Nachbar {name} grüßt.", 2), ("La casa de {name} es azul.", 2), ("Tomorrow {name} sings.", 3), ("They gave {name} a medal.", 3), ("Thanks, {name}", 2), ("On behalf of {name}, we write.", 2), ("Das Auto gehört {name} seit Mai.", 2), ("Der Bruder von {name} kocht.", 2), ("Das Haus von {name} steht leer.", 2), ("Die Katze von {name} schläft.", 2), ("Der Brief von {name} kam an.", 2), ("Eine Tante von {name} singt.", 2), ("El coche de {name} no arranca.", 2), ("Die Stimme von {name} war leise.", 2), ("La voiture de {name} est rouge.", 2), ("El hermano de {name} cocina.", 2), ("Llame a {name} mañana.", 2), ("Her son {name} plays the flute.", 3), ("On Monday {name} returned.", 3), ("-- {name}", 2), ("\"It works\", said {name}.", 3),
    # decoys: nothing but what is marked counts
    ("Invoice no. {badhealth} is unpaid.", 4), ("Order {badhealth} was packed.", 3), ("Tracking code {goodhealth} is live.", 2), ("Booking no. {goodhealth} is confirmed.", 2), ("Case {goodhealth} was closed.", 1), ("Release {build} is out.", 4), ("Ref. {nino} is archived.", 4), ("Part number {nino} is sold out.", 3), ("Batch {long} failed.", 4), ("Serial {long}.", 3), ("Patient number {badhealth} does not exist.", 3), ("ISBN 978-3-16-{six}-0 is a novel.", 2), ("From 2021-05-17 to 2021-06-30.", 2), ("Doors 19:30 2{one}/0{one}/202{one}, seat {two}.", 3), ("On 1{one}.0{one}.199{one} 20{two} came.", 2), ("Paid 1{one}-0{one}-2019 08{two}.", 2), ("The server is 192.168.10.{two}.", 2), ("Population: 1 {two}0 345 678.", 2),
    ("Follow @{low}_{two} for updates.", 3), ("Eggs 2.40 @ market, 1.99 @ farm.", 3), ("He excels at work dot com or not.", 3), ("We stayed at town dot net cafes.", 3), ("Prices at shop dot org were fair.", 2), ("Look at this dot plot there.", 2),
    ("The {two} {street} Road buses were late.", 3), ("The {street} Avenue bridge is shut.", 3), ("{street} Street was quiet.", 3), ("We walked {two} miles on the way to town.", 3), ("{two} people in the park sang.", 3), ("About {two} cars a day use the old road here.", 3), ("The {street} Terrace café is loud.", 2), ("After {two} minutes he took first place.", 3), ("In round {two} they lost their way.", 2), ("Nach {two} Minuten war der Weg frei.", 2),
    ("{place} and {place} are twinned.", 4), ("{pair} is warm in June.", 2), ("A letter from {pair} came.", 2), ("Yesterday {Family} won.", 2), ("Unsere Firma {Family} wächst.", 1), ("{company} hired {two} clerks.", 5), ("The {company} sale.", 3), ("Der Alte Markt und die Neue Brücke.", 2), ("Die Deutsche Bank zahlt.", 2), ("Der Blaue Reiter und die Grüne Woche.", 2), ("Apple Music and Adobe Reader.", 2), ("Hyper Text and Open Source.", 1), ("El Banco Central y la Gran Vía.", 2), ("Central Park, Wall Street and Times Square.", 2), ("North Gate and South Gate are shut.", 2), ("Victoria Park and Albert Bridge.", 2), ("He works for {company} in {place}.", 5), ("{place} {body} met {place} {body} again.", 5), ("{made} {body} won the tender.", 5), ("{made} {body} against {made} {body} was dull.", 4), ("Fans of {made} {body} sang.", 4), ("{made} {body} {made} {body} at noon.", 3), ("{made} {body}\n{made} {body} moved.", 3), ("They left {made} {body}\n{Given} slept.", 2), ("Nobody at {made} {body} knew.", 3), ("{made} {body} and {made} {body} merged with {company}.", 2), ("{Given} laughed.", 4), ("{Family} was late.", 3), ("{Given}, the plumber, left.", 3), ("So {Given} and {Given} agreed.", 3), ("Gegen {made} war der Ball rund.", 3), ("Ohne {Family} geht die Firma unter.", 3), ("Nach {made} fährt ein Bus, die Karte kostet wenig.", 2), ("Para {Family} la noche fue larga.", 2), ("Before {made} {body}, {Family} slept.", 3), ("With {Family} away, {Given} cooks.", 3), ("Under {Family} the firm grew.", 2), ("From {made}, {two} buses run.", 2), ("Tell {Given} about it.", 2), ("{Family} and {Family} agreed, {Family} did not.", 3), ("On Good Friday the Royal Mail rests.", 2), ("New Zealand beat South Africa.", 2), ("Happy Birthday, {Given}!", 2), ("Merry Christmas and a Happy New Year!", 2), ("See Chapter Two, Section Four.", 2), ("United Nations, World Bank, Red Cross.", 2), ("The Daily Telegraph and the Sunday Times.", 2),
]
BODY = ["United", "City", "Rovers", "Town", "Athletic", "Bank", "Council", "Museum", "School", "Ltd", "Wanderers", "Station", "Rangers", "County", "Albion", "Group"]


def build(given: list[str], family: list[str], n: int = 4800, seed: int = 7) -> list[Example]:
    """``n`` texts of marked sentences between fillers, with the segments' places. A quarter of the names are from
    ``given`` and ``family``, half from the public stocks, a quarter in neither."""
    r = random.Random(seed)
    made_up = ([_coined(r, 1, 2) for _ in range(400)], [_coined(r, 2, 3) for _ in range(400)])
    stocks = [(given, family)] * bool(given and family) + [(GIVEN, FAMILY), (GIVEN, FAMILY), made_up]
    pool = [t for t, k in TEMPLATES for _ in range(k)]
    out: list[Example] = []
    for _ in range(n):
        gs, fs = r.choice(stocks)
        g, f = r.choice(gs), r.choice(fs)
        plain = lambda s: "".join(c for c in s.lower() if c.isascii() and c.isalpha()) or "kim"
        made = lambda: r.choice(fs)[: r.randint(3, 6)] + r.choice(["ford", "mere", "gate", "ham", "ton", "wick", "by", "stead"])
        text, gold = "", set()

        def put(s: str, kind: str | None = None) -> None:
            nonlocal text
            if kind:
                gold.add((len(text), len(text) + len(s), kind))
            text += s

        for k in range(r.choice([1, 1, 2])):
            if r.random() < 0.6:
                put(r.choice(FILLER) + r.choice([" ", " ", "\n", "\n\n"]))
            rest = r.choice(pool)
            while "{" in rest:
                before, _, after = rest.partition("{")
                slot, _, rest = after.partition("}")
                put(before)
                if slot == "email":
                    put(_email(r, plain(g), plain(f)), "email")
                elif slot == "phone":
                    put(_phone(r), "phone")
                elif slot == "identity":
                    put(_identity(r), "identity")
                elif slot == "address":
                    put(_address(r), "address")
                elif slot == "name":
                    put(_name(r, g, f, gs, fs), "name")
                    g, f = r.choice(gs), r.choice(fs)
                else:
                    put({
                        "badhealth": lambda: _health(r, False), "goodhealth": lambda: _health(r, True), "nino": lambda: _nino(r),
                        "build": lambda: f"0{_digits(r, 2)}.{_digits(r, 2)}.{_digits(r, 2)}-{_digits(r, 2)}", "six": lambda: _digits(r, 6),
                        "long": lambda: str(r.randint(1, 9)) + _digits(r, r.randint(8, 12)), "two": lambda: str(r.randint(2, 99)), "one": lambda: str(r.randint(1, 9)), "low": lambda: plain(g),
                        "street": lambda: r.choice(STREETS), "place": lambda: r.choice(PLACES), "company": lambda: r.choice(COMPANIES), "body": lambda: r.choice(BODY), "pair": lambda: r.choice(PAIRS),
                        "made": made, "Given": lambda: r.choice(gs), "Family": lambda: r.choice(fs),
                    }[slot]())
            put(rest + r.choice([" ", "\n"]) + r.choice(["", r.choice(FILLER)]) + " ")
        u = r.random()
        if u > 0.9:  # some have lost their points
            kept = [k for k, c in enumerate(text) if c not in ".!?;" or any(a <= k < b for a, b, _ in gold)]
            at = {k: n for n, k in enumerate(kept)} | {len(text): len(kept)}
            gold = {(at[a], at[b - 1] + 1, kind) for a, b, kind in gold}
            text = "".join(text[k] for k in kept)
        if u < 0.16 and len(text.upper()) == len(text):  # some texts are all capitals
            text = text.upper()
        out.append((text, gold))
    return out


def fit(given: list[str], family: list[str], classes: dict[str, str], n: int = 4800, seed: int = 7):
    """A model trained on names most of which are not in its stocks, and then given all of them."""
    from tidemark.llm import pii

    part = pii.NameModel.fit(given[::2] + GIVEN[::3], family[::2] + FAMILY[::3], classes)
    weights = pii.train(build(given, family, n, seed), part)
    return pii.Model(pii.NameModel.fit(given + GIVEN, family + FAMILY, classes), weights)
