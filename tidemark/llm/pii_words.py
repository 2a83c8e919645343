"""Fixed values of the search for personal information: public name stocks, cue words and place words.

The lists are plain knowledge about languages, kept short on purpose; what they don't hold is
judged by letter patterns, by a public vocabulary and by the words around.
"""

from __future__ import annotations

import base64
import unicodedata

# Common given names.
GIVEN = (
    "James Robert John Michael David William Richard Thomas Charles Daniel Matthew Anthony Mark Steven Paul Andrew Joshua Kevin Brian George "
    "Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Stephen Jonathan Larry Justin Scott Brandon Benjamin Samuel Gregory Patrick "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Sandra Margaret Ashley Kimberly Emily Donna Michelle "
    "Carol Amanda Melissa Deborah Stephanie Rebecca Laura Sharon Cynthia Kathleen Amy Angela Shirley Anna Ruth Brenda Pamela Nicole Katherine Helen "
    "Oliver Harry Jack Alfie Henry Freya Imogen Poppy Isla Sophie Chloe Lucy Hannah Megan Rhys Gareth Fiona Sean Siobhan Callum "
    "Hans Klaus Jürgen Stefan Andreas Wolfgang Uwe Sabine Monika Petra Ursula Heike Katrin Anja Lukas Felix Greta Lena Carlos José Luis Javier "
    "Miguel Antonio Fernando Carmen Lucía Pilar Isabel Elena Rosa Pierre Jean Michel Philippe Claire Camille Sylvie Giulia Marco Luca Francesca "
    "Paolo Chiara João Ana Sofia Tiago Ahmed Mohammed Omar Fatima Aisha Yusuf Layla Wei Li Ming Mei Hiroshi Yuki Kenji Sakura "
    "Priya Raj Amit Anil Deepa Sanjay Olga Ivan Dmitri Natasha Sergei Piotr Agnieszka Katarzyna Lars Erik Ingrid Astrid Sven Kwame Amara Chidi"
).split()

# Common family names.
FAMILY = (
    "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Thompson White Harris Clark Lewis Robinson Walker "
    "Young Allen King Wright Scott Hill Green Adams Baker Hall Nelson Carter Mitchell Roberts Turner Phillips Campbell Parker Evans Edwards "
    "Collins Stewart Morris Murphy Cook Rogers Morgan Cooper Reed Bailey Bell Kelly Howard Ward Cox Richardson Wood Watson Brooks Bennett Gray "
    "Hughes Price Foster Sanders Ross Barnes Powell Sullivan Russell Fisher Henderson Coleman Simpson Patterson Reynolds Hamilton Graham Wallace "
    "West Cole Hayes Bryant Gibson Ellis Stevens Murray Ford Marshall Owens Kennedy Wells Woods Palmer Holmes Robertson Shaw Hunter Dixon "
    "Whitaker Fairbanks Ashdown Thornbury Middleton Haywood Bradshaw Lockwood Underwood Kingsley Müller Schmidt Schneider Fischer Weber Meyer "
    "Wagner Becker Hoffmann Schäfer Koch Bauer Richter Klein Wolf Schröder Neumann Zimmermann García Rodríguez Martínez Hernández López González "
    "Pérez Sánchez Ramírez Torres Flores Díaz Dubois Durand Moreau Laurent Lefebvre Rossi Russo Ferrari Bianchi Romano Silva Santos Ferreira "
    "Oliveira Khan Ali Hussain Ibrahim Hassan Chen Wang Zhang Liu Yang Huang Nguyen Tran Kim Park Tanaka Suzuki Sato Patel Sharma Singh Gupta "
    "Ivanov Petrov Novak Kowalski Nowak Hansen Nielsen Larsen Johansson Andersson Okafor Mensah Adeyemi"
).split()

# Words that point to what follows or goes before, by kind.
CUES = {
    "title": "mr mrs ms miss mx dr prof professor sir madam rev herr frau señor señora sr sra don doña monsieur mme signor signora "
    "madame nachbar nachbarin kollege kollegin firma chef chefin lehrer lehrerin arzt ärztin patientin kunde kundin direktor direktorin vecino vecina voisin voisine uncle aunt president chairman captain judge lord lady king queen saint",
    "person": "name named called dear regards sincerely thanks sender from signed by neighbour neighbor patient client customer employee colleague "
    "tenant applicant guest contact attn recipient owner witness nurse teacher manager admin secretary de von par an a al for to with and "
    "und y et namens gracias danke merci bitte",
    "call": "call ring phone telephone tel mobile cell fax dial text sms whatsapp line hotline landline extension telefon handy anrufen teléfono "
    "móvil llame llamen llamar téléphone appelez numero número nummer number office reception desk switchboard on under unter contact",
    "mail": "mail email e-mail mailto inbox write reply send correo escriba escriban schreiben courriel address contact cc bcc to at via reached reach",
    "id": "insurance national ni nino social security ssn nhs health identity identification id taxpayer patient card sozialversicherung steuer dni nie",
    "where": "address lives live living resides residence delivery deliver delivered ship shipped send post parcel home house adresse wohnt "
    "dirección domicilio vive adresse habite at to near invoice billing located",
    "serial": "ticket order fixture build ref reference invoice version case run booking receipt tracking batch serial part item model isbn sku "
    "code page account release issue bug claim voucher lot policy route flight tag rev revision patch barcode parcel meter",
}

# Last words of the names of organisations, grounds and places rather than people.
BODIES = frozenset(
    "united city rovers town athletic albion wanderers vale borough harriers county rangers villa forest palace fc afc club league cup trophy "
    "ltd limited inc corp corporation company co plc gmbh group holdings bank university college school academy institute hospital clinic church "
    "museum gallery library theatre hotel council committee department ministry agency association society trust foundation union party street "
    "road lane avenue close crescent terrace way drive place square court park gardens bridge station stadium stand arena ground centre center hall "
    "tower house building airport river lake mountain valley island bay beach north south east west central republic kingdom states "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december "
    "times post news herald journal press act law st rd ave blvd ln ct plaza".split()
)

# Little words of other languages that begin sentences.
LITTLE = frozenset(
    "contra ante con sin para por desde hasta entre sobre según tras pero como cuando el la los las un una al del "
    "gegen ohne nach vor mit bei von zu aus seit während trotz wegen über unter zwischen aber wenn der die das ein eine im am beim vom "
    "avec sans pour contre chez dans sous sur mais quand le les une des au aux".split()
)

# Places whose names look like those of people, and other places.
PLACES = (
    "London Paris Berlin Madrid Rome Vienna Dublin Manchester Liverpool Leeds Bristol Sheffield Newcastle Glasgow Edinburgh Cardiff Belfast York "
    "Oxford Cambridge Brighton Norwich Chicago Boston Houston Dallas Denver Seattle Atlanta Portland Austin Phoenix Toronto Sydney Melbourne "
    "Hamburg Munich Cologne Barcelona Valencia Lisbon Porto Milan Turin Naples Lyon Marseille Amsterdam Rotterdam Brussels Warsaw Prague Budapest "
    "Oslo Stockholm Copenhagen Helsinki Athens Cairo Lagos Nairobi Mumbai Delhi Tokyo Osaka Beijing Shanghai Seoul"
).split()

# Names of places, bodies and brands in two words.
PAIRS = [
   "Hong Kong", "Los Angeles", "San Diego", "Santa Rosa", "Saint Louis", "Wells Green", "Buenos Aires", "Sri Lanka", "Las Vegas", "Tel Aviv", "Costa Rica", "Puerto Rico", "Santa Cruz", "Saint Lucia", "Real Sociedad", "Deutsche Post", "Rolls Royce", "Coca Cola", "Burkina Faso", "San Marino", "Baden Baden", "Monte Carlo", "Addis Ababa", "Kuala Lumpur", "Wells Fargo", "Saudi Arabia", "Nova Scotia", "Sierra Leone", "Rio Grande", "Northern Ireland", "Mount Everest", "Lake Como",
]

PARTICLES = frozenset("de del della da do dos di du des la le las los van von der den ter ten zu bin ibn al el af av".split())


def cue_classes() -> dict[str, tuple[str, ...]]:
    """Folded cue word → its classes."""
    out: dict[str, tuple[str, ...]] = {}
    for kind, ws in CUES.items():
        for w in ws.split():
            w = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))
            out[w] = tuple(dict.fromkeys((*out.get(w, ()), kind)))
    return out


def word_classes(vocabularies: list[str]) -> dict[str, str]:
    """What public byte-level vocabularies (ranks files) say of lower-cased words that are single tokens.

    'common' or 'known': the lower-case form ranks before the capitalised one (by 8000 or later);
    'proper': written with a capital more often in all that hold it. Words in none are rare.
    """
    out: dict[str, str] = {}
    for v in vocabularies:
        for w, c in _classes(v).items():
            if out.get(w, "proper") == "proper":
                out[w] = c
    return out


def _classes(vocabulary: str) -> dict[str, str]:
    low: dict[str, int] = {}
    cap: dict[str, int] = {}
    with open(vocabulary, "rb") as f:
        for line in f:
            tok, rank = line.split()
            try:
                s = base64.b64decode(tok).decode()
            except UnicodeDecodeError:
                continue
            if len(s) > 2 and s[0] == " " and s[1:].isalpha():
                w = s[1:]
                if w.islower():
                    low[w] = int(rank)
                elif w[0].isupper() and w[1:].islower():
                    cap[w.lower()] = int(rank)
    far = 1 << 30
    return {
        w: ("common" if low[w] < 8000 else "known") if low.get(w, far) < cap.get(w, far) else "proper" for w in low.keys() | cap.keys()
    }
