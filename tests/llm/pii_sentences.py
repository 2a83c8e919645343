"""Marked sentences that the segment model is measured on: other sentences, names, numbers and addresses than the
ones it is trained on. «kind:text» marks a span."""

import itertools
import re

NAMES = [
    "Sarah Whitcombe", "Desmond Oyelaran", "Bartholomew Quigley", "Ravindra Subramaniam", "Noor Haddad", "Tobias Engelhardt", "Maeve Gallagher", "Leopold Strand",
    "Beatriz Villanueva", "Gunnar Thorvaldsen", "Yolanda Pereira", "Cedric Blanchard", "Tamsin Holroyd", "Ines Carvalho", "Mateusz Wysocki", "Eleanor Featherstone", "Jasper Vandermeer",
    "Harriet Osborne", "Nadia Rahman", "Rupert Cavendish", "Maria del Carmen Lozano", "Jan van der Velde", "Ahmad bin Rashid", "Peter J. Hollis", "Agnes Mary Dunbar", "Emily Clarkson", "Roberta Chenoweth",
    "Theodore Blackwood", "Gloria Mendoza", "Colin McAllister", "Bernadette O'Leary", "Anouk Lemaire", "Victor Ostrowski", "Phoebe Ravenscroft", "Samira Youssef", "Walter Grunwald", "Zoe Papadakis", "Hugo Lindqvist", "Keiko Matsuda", "Diego Castellanos",
]
EMAILS = [
    "billing@acmewidgets.co.uk", "s.whitcombe@lumen-labs.org", "tobias_engelhardt84@t-online.example", "press-desk@riverbank.gov", "noor.h@mailbox.io", "INFO@VILLAGEHALL.ORG", "maeve77 at quickpost dot com",
    "leo [at] strand [dot] net", "gunnar(at)fjord.no", "bookings2@theoldmill.pub", "c.blanchard+kids@orange.fr", "team@startup.dev", "jasper (at) vdm (dot) nl", "a.b.c@x-y-z.eu", "eleanor.featherstone@cs.ox.ac.uk", "harriet-osborne @ paper.example",
]
PHONES = [
    "020 7183 8750", "+44 20 7183 8750", "07812 345 678", "+44 7812 345678", "(0113) 496 0321", "0113 496 0321", "+1 (415) 867-5309", "415-867-5309", "(415) 867-5309", "415.867.5309", "+49 170 4567890", "0171/4567890",
    "+34 612 345 678", "+33 6 12 34 56 78", "06 12 34 56 78", "+39 347 123 4567", "0044 113 496 0321", "+31 6 12345678", "1-888-452-1505", "01865 270000",
]
IDENTITIES = [
    "AB123456C", "JG 10 37 59 A", "HK-20-48-61-B", "nx 55 11 22 d", "CE998877D", "219-09-9999", "457-55-5462", "078 05 1120", "943 476 5919", "9434765919", "401-023-2137", "450 557 7104", "6328797966", "QQ 12 34 56 A", "LM 44 55 66 C", "529-14-3321",
]
ADDRESSES = [
    "12 Mulberry Road, Guildford GU2 7XH", "Flat 4, 88 Tower Hill, Norwich, NR1 3BX", "221B Baker Street, London NW1 6XE", "7 Lower Church Lane, Ludlow SY8 1AA", "Apartment 9, 16 Dock Road, Hull, HU1 2PQ", "1600 Pennsylvania Avenue NW, Washington, DC 20500",
    "742 Evergreen Terrace, Springfield, OR 97477", "350 Fifth Avenue, New York, NY 10118", "12 rue de Rivoli, 75001 Paris", "45 avenue Jean Jaurès, 69007 Lyon", "Hauptstraße 12, 10115 Berlin", "Gartenweg 3a, 80331 München", "Calle Mayor 8, 28013 Madrid", "Via Nazionale 54, 00184 Roma",
    "Unit 6, 30 Canal Wharf Street, Leeds LS11 5PS", "19 Rosebery Avenue, Plymouth PL4 8SL", "5 The Old Brewery Lane, Henley RG9 1AB", "64 Ringelberg Street, Salford M5 4WT",
]
CARRIERS = {
    "name": [
        "The violin was lent to {} for the winter.", "Minutes taken by {} on behalf of the board.", "Yesterday {} opened the exhibition.", "I owe {} a coffee.", "Many thanks, {}", "Professor {} lectures on bees.", "Die Nichte von {} malt gern.",
        "No one but {} has the keys.", "Could you let {} know?", "The portrait of {} hangs upstairs.", "{} baked all the bread.", "El contrato lo firmó {} ayer.",
    ],
    "email": [
        "Reach our billing team: {}", "Complaints should be addressed to {} within a week.", "You may unsubscribe by writing to {} at any time.", "{} is no longer monitored.", "We got no answer from {}, so we phoned.", "Feedback welcome ({}).", "Fragen bitte an {}.", "Use {} when ordering seeds.",
    ],
    "phone": [
        "Bookings on {} only.", "If locked out, try {}.", "The plumber's number was {} last year.", "Voicemail at {} is full.", "Tel {} (evenings)", "WhatsApp us: {}", "Notruf: {}", "Her new mobile number, {}, is not listed.",
    ],
    "identity": [
        "National insurance {} was recorded.", "Your social security number ({}) appears on page two.", "Payroll holds {} for her.", "The hospital wristband read {}.", "Tax file: {}", "He quoted {} when asked for his NHS number.", "I typed {} into the pension form.",
    ],
    "address": [
        "The package was left at {} by mistake.", "Their registered office is {}.", "Turn left and you will find {} on the corner.", "Moved house: new place is {} from June.", "Collect the keys from {} before ten.", "Absender: {}", "A fire broke out at {} overnight.",
    ],
}
VALUES = {"name": NAMES, "email": EMAILS, "phone": PHONES, "identity": IDENTITIES, "address": ADDRESSES}
#: Sentences that hold nothing private.
CLEAN = [
    "The South Bank Centre reopens in May.", "Version 10.4.2 replaces 9.12.", "Flight BA 2490 leaves at 06:45 from Terminal 5.", "We sold 1 204 500 units in 2022.", "Invoice 4417-2231-09 was cancelled.", "Please follow @gardenclub on the usual sites.",
    "Green Park and Hyde Park are close.", "The Bank of England raised rates.", "Meet at noon dot on the dot.", "Look at page 7 dot points only.", "Bristol Rovers lost to Leyton Orient.", "The Old Kent Road is busy.", "Route 66 runs west.", "It cost 12.50 @ the market.",
    "Chapter Three begins in Lower Saxony.", "Der Schwarze Wald liegt im Süden.", "Das Rote Kreuz hilft seit Jahren.", "La Casa Blanca está lejos.", "Part no. 10-22-45-88 is discontinued.", "Parcel 00340434161094015902 is on its way.", "In 1998 about 300 people lived on the hill.",
    "Deutsche Bahn trains were late again.", "Ocean City hosts Silver Lake on Saturday.", "Queen Street was closed for repairs.", "Ticket no. 9434765919 is void.", "Order 401-023-2137 has shipped.", "Happy New Year to all Members!", "The Great North Run starts at ten.", "Reference JG-10-37-59-A belongs to the archive.", "Microsoft Word and Google Maps crashed.",
    "Temperatures of 21 to 25 degrees are likely in the south.", "The court held a way must stay open.", "Sunday Lunch is served from 12:00 to 15:30.", "Room 14 on the third floor has no view.", "Saint Patrick was no American.",
]


def sentences() -> list[tuple[str, set[tuple[int, int, str]]]]:
    out = []
    for kind, carriers in CARRIERS.items():
        values = VALUES[kind]
        n = max(len(values) * 2, len(carriers) * 8)
        for v, c in itertools.islice(zip(itertools.cycle(values), itertools.cycle([*carriers, carriers[0]]), strict=False), n):
            head, tail = c.split("{}")
            out.append((head + v + tail, {(len(head), len(head) + len(v), kind)}))
    return out + [(t, set()) for t in CLEAN]


def carrier_words(text: str) -> str:
    return re.sub(r"\W+", " ", text).strip().lower()
