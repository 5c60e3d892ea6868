"""What has to be the same everywhere for the same results, plainly and in its natural order.

Word lists, weights, patterns and limits below are part of the behaviour that the engine is to have, not of
its design; nothing here is computed. Patterns are in Python's syntax.
"""

# ---- headings: (level, pattern, whether case is ignored); an optional bullet may lead each ----
BULLET = r"(?:[-*•]\s+)?"
MARKDOWN_HEADING = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
GERMAN_HEADINGS = (
    (2, rf"^{BULLET}§+\s*\d+[a-zA-Z]?(?:\s+\S.{{0,70}})?$", False),
    (2, rf"^{BULLET}(?:Abschnitt|Kapitel|Artikel|Anlage|Anhang|Teil|Punkt)\s+[IVXLCDM\d]+(?:[.)])?(?:\s+\S.{{0,70}})?$", True),
    (3, rf"^{BULLET}\d+\.\d+(?:\.\d+)*\s+\S.{{0,60}}$", False),
)
HEADING_LENGTH = 90
HEADING_NEVER_ENDS_WITH = ".!?:;,"
PARAGRAPH_MARKER = r"\(\d{1,3}[a-z]?\)"

# ---- language ----
GERMAN_MARKERS = tuple("der die das den dem des und oder aber ist sind nicht mit von für auf werden wird sich auch bei aus nach über eine einer einem einen dass wenn kann muss soll zur zum im am".split())
ENGLISH_MARKERS = tuple("the and or but is are not with of for on from by be as it this that these those will shall must can to in at we you they".split())
LEAST_MARKERS = 3

# ---- sentences ----
CLOSING_MARKS = "\"'“”«»)]}"
OPENING_MARKS = "„“”\"'»«([{"
NUMBERED_SUFFIXES = ("bde", "bd", "nrn", "nr", "pl", "str")
DATE_ABBREVIATIONS = tuple("jan feb mär apr jun jul aug sep sept okt nov dez mo di mi do fr sa so".split())
ROMAN_DIGITS = "IVXLCDM"
MONTHS = tuple("januar februar märz april mai juni juli august september oktober november dezember".split())
REFERENCE_ABBREVIATIONS = tuple("rn. rz. randnr. nr. nrn. no. nos. abs. s. ziff. anm. az. aktz. art. artt. bd. bde. kap. bl. lit. buchst. halbs. var. tab. anl. anh. fig. pos. pkt. vgl.".split())
CLOSING_ABBREVIATIONS = (
    "usw.", "usf.", "etc.", "u. a.", "u.a.", "u. ä.", "u.ä.", "o. ä.", "o.ä.", "u. a. m.", "u. v. a.", "u. v. m.", "dgl.", "desgl.", "ebd.", "ff.", "v. chr.", "v.chr.", "n. chr.", "n.chr.",
    "bgb.", "stgb.", "stpo.", "zpo.", "hgb.", "ao.", "ustg.", "stvo.",
)
SENTENCE_OPENERS = tuple(
    (
        "der die das den dem des ein eine einen einem einer eines er sie es ihm ihn ihnen ihr wir uns unser ich mich mir mein du dich dir euch wer wen wem man jede jeder jedes diese dieser dieses diesen diesem "
        "jene jener jenes alle beide solche welche welcher welches dies "
        "danach davor daher darum deshalb deswegen trotzdem außerdem zudem ferner weiter dann nun so auch nur nicht kein keine keinen keiner hier dort heute morgen gestern jetzt bald oft meist immer nie wieder "
        "jedoch doch aber oder und denn also somit folglich schließlich zuletzt zunächst zuerst anschließend ebenso ebenfalls hingegen dagegen vielmehr allerdings zwar jedenfalls mindestens höchstens etwa rund "
        "insgesamt damit dafür dazu dabei dadurch hiermit hierbei hierfür hiervon insofern soweit "
        "im in am an auf aus bei für mit nach von vor zu zum zur über unter zwischen ohne gegen bis seit während laut gemäß wegen trotz statt innerhalb außerhalb bezüglich hinsichtlich "
        "ist sind war waren wird werden wurde wurden hat haben hatte hatten kann können konnte muss müssen soll sollen darf dürfen will wollen gibt geben gilt gelten bleibt bleiben "
        "bitte siehe beachten hinweis hinweise wichtig achtung vorsicht"
    ).split()
)

# ---- compounds ----
LINKING_ELEMENTS = ("", "s", "es", "ns", "n", "en", "er", "e")
LEAST_PART, MOST_PARTS = 3, 5
LIGHT_SUFFIXES = ("ungen", "ung", "ern", "em", "er", "en", "es", "e", "n", "s")

# ---- prompt injections: (rule, pattern, severity); case is ignored ----
INJECTIONS = (
    ("ignore_instructions", r"\b(?:ignore|disregard|forget)\s+(?:all\s+)?(?:the\s+)?(?:previous|prior|above|earlier|foregoing)\s+instructions?", "high"),
    ("ignore_instructions_de", r"\b(?:ignorier|vergiss|missachte|verwerfe)\w*\s+(?:bitte\s+)?(?:alle\s+)?(?:vorherigen|vorigen|obigen|bisherigen|früheren)\s+(?:anweisungen|anweisung|instruktionen|hinweise)", "high"),
    ("new_instructions", r"\b(?:neue|neuen|geänderte)\s+(?:anweisung|anweisungen|instruktionen)\b", "medium"),
    ("override_instructions", r"\boverride\s+(?:the\s+)?(?:instructions?|rules?|system)\b", "high"),
    ("system_prompt", r"\bsystem[\s_-]?(?:prompt|nachricht|message|anweisung)\b", "medium"),
    ("role_reassignment", r"\b(?:you are now|from now on you are|du bist (?:jetzt|nun)|ab jetzt bist du)\b", "high"),
    ("act_as", r"\b(?:act as|agiere als|verhalte dich wie|tu so als)\b", "medium"),
    ("reveal_instructions", r"\b(?:reveal|show|print|repeat|gib|zeige|wiederhole)\w*\s+(?:your|deine?n?|alle)\s+(?:instructions?|prompt|anweisungen|regeln)", "high"),
    ("role_marker", r"^\s*(?:#{2,}\s*)?(?:system|assistant|user|entwickler)\s*:", "medium"),
    ("special_token", r"<\|(?:system|assistant|user|im_start|im_end|endoftext)\|>", "high"),
    ("exfiltrate", r"\b(?:sende|schicke|leite)\w*\s+(?:alle|die)\s+(?:daten|dokumente|informationen)\s+(?:an|nach)\b", "medium"),
)

# ---- identifiers: words near them, and (name, type, pattern, group, confidence, context, whether it is needed) ----
CONTEXT_WORDS = {
    "iban": ("iban", "kontonummer", "bankverbindung", "konto", "empfängerkonto"),
    "bic": ("bic", "swift", "bankverbindung", "bankleitzahl"),
    "vat": ("ust-idnr", "ust-id", "ust.", "umsatzsteuer", "mehrwertsteuer", "vat", "steuernummer"),
    "tax_id": ("steuer-id", "steuerid", "steuer-identifikationsnummer", "identifikationsnummer", "idnr", "id-nr"),
    "tax_number": ("steuernummer", "steuer-nr", "st.-nr", "st-nr", "stnr", "finanzamt"),
    "svnr": ("sozialversicherung", "sozialversicherungsnummer", "svnr", "rentenversicherung", "krankenkasse", "versicherungsnummer"),
    "id_card": ("personalausweis", "ausweisnummer", "ausweis-nr", "ausweis", "identitätsnachweis"),
    "phone": ("tel", "telefon", "telefonnummer", "mobil", "mobilnummer", "fax", "ruf", "erreichbar", "durchwahl", "ansprechpartner"),
    "plz": ("plz", "postleitzahl", "postfach"),
    "address": ("adresse", "anschrift", "anschriften", "straße", "str.", "wohnhaft"),
    "person": ("herr", "frau", "hr.", "fr.", "ansprechpartner", "name", "geboren"),
}
CONTEXT_WINDOW = 60
IDENTIFIER = r"([A-Za-z0-9][A-Za-z0-9./_-]{2,})"
STREET = r"(?:straße|strasse|str\.?|weg|allee|platz|gasse|ring|damm|ufer|steig|chaussee|graben|markt|berg|feld|hof|garten|park)"
RECOGNIZERS = (
    ("de_iban", "DE_IBAN", r"\bDE\d{2}(?:[ ]?\d{4}){4}[ ]?\d{2}\b", 0, 0.99, "iban", False),
    ("de_bic", "DE_BIC", r"\b[A-Z]{4}DE[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", 0, 0.85, "bic", True),
    ("de_vat_id", "DE_VAT_ID", r"\bDE\d{9}\b", 0, 0.8, "vat", False),
    ("de_tax_id", "DE_TAX_ID", r"\b\d{2}[ ]?\d{3}[ ]?\d{3}[ ]?\d{3}\b", 0, 0.95, "tax_id", False),
    ("de_tax_number", "DE_TAX_NUMBER", r"\b\d{2,3}\s?/\s?\d{3}\s?/\s?\d{4,5}\b", 0, 0.85, "tax_number", True),
    ("de_svnr", "DE_SVNR", r"\b\d{8}[A-Z]\d{3}\b", 0, 0.9, "svnr", False),
    ("de_id_card", "DE_ID_CARD", r"\b[A-Z]\d{8}\b", 0, 0.8, "id_card", True),
    ("de_hr_number", "DE_HR_NUMBER", r"\bHR[AB]\s?\d{1,7}\s?[A-Z]?\b", 0, 0.9, None, False),
    ("de_plz", "DE_PLZ", r"\b\d{5}\b", 0, 0.8, "plz", True),
    ("de_address", "DE_ADDRESS", rf"\b[A-ZÄÖÜ][\wÄÖÜäöüß.-]{{0,30}}{STREET}\s+\d{{1,4}}\s?[a-zA-Z]?(?:\s?[-–]\s?\d{{1,4}}[a-zA-Z]?)?", 0, 0.85, "address", False),
    ("de_mobile", "PHONE", r"\b01[567]\d(?:[\s/.-]?\d){6,7}\b", 0, 0.9, "phone", False),
    ("de_phone_intl", "PHONE", r"\+49[\s/.-]?\(?\d{1,5}\)?[\s/.-]?\d{2,8}(?:[\s/.-]?\d{1,8})?", 0, 0.9, "phone", False),
    ("de_phone", "PHONE", r"\b0\d{1,5}[\s/.-]\d{2,8}(?:[\s/.-]?\d{1,8})?", 0, 0.85, "phone", True),
    ("email", "EMAIL", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", 0, 0.95, None, False),
    ("de_invoice_number", "DE_INVOICE_NUMBER", rf"(?:Rechnungs?(?:nummer|nr\.?)|Rechnung\s*Nr\.?)\s*[:#]?\s*{IDENTIFIER}", 1, 0.9, None, False),
    ("de_customer_number", "DE_CUSTOMER_NUMBER", rf"(?:Kunden(?:nummer|nr\.?)|Kd\.?-?\s?Nr\.?)\s*[:#]?\s*{IDENTIFIER}", 1, 0.9, None, False),
    ("de_order_number", "DE_ORDER_NUMBER", rf"(?:Auftrags?(?:nummer|nr\.?)|Bestell(?:nummer|nr\.?))\s*[:#]?\s*{IDENTIFIER}", 1, 0.9, None, False),
    ("de_contract_number", "DE_CONTRACT_NUMBER", rf"(?:Vertrags?(?:nummer|nr\.?)|Vertrag\s*Nr\.?)\s*[:#]?\s*{IDENTIFIER}", 1, 0.9, None, False),
)
#: Of the recognisers above, those that ignore case.
IGNORING_CASE = ("de_address", "de_invoice_number", "de_customer_number", "de_order_number", "de_contract_number")

# ---- kinds of documents: (kind, cue, weight) ----
CUES = (
    ("invoice", "rechnungsnummer", 3.0),
    ("invoice", "rechnungsbetrag", 3.0),
    ("invoice", "rechnungsdatum", 2.5),
    ("invoice", "nettobetrag", 3.0),
    ("invoice", "umsatzsteuer", 2.0),
    ("invoice", "zahlbar innerhalb", 3.0),
    ("invoice", "zahlbetrag", 2.0),
    ("invoice", "rechnung", 1.0),
    ("contract", "vertragsparteien", 3.0),
    ("contract", "kündigungsfrist", 3.0),
    ("contract", "vertragsgegenstand", 3.0),
    ("contract", "auftragnehmer", 2.0),
    ("contract", "auftraggeber", 2.0),
    ("contract", "vereinbarung", 1.5),
    ("contract", "rahmenvertrag", 3.0),
    ("contract", "vertrag", 1.0),
    ("offer", "angebotsnummer", 3.0),
    ("offer", "gültig bis", 2.5),
    ("offer", "wir bieten", 2.5),
    ("offer", "angebot", 1.5),
    ("order", "bestellnummer", 3.0),
    ("order", "auftragsbestätigung", 3.0),
    ("order", "liefertermin", 2.5),
    ("order", "bestellung", 1.5),
    ("legal_document", "verordnung", 2.5),
    ("legal_document", "bundesgesetzblatt", 3.0),
    ("legal_document", "urteil", 2.5),
    ("legal_document", "gesetz", 1.5),
    ("legal_document", "vorschrift", 1.5),
    ("hr_document", "arbeitsvertrag", 3.0),
    ("hr_document", "urlaubsantrag", 3.0),
    ("hr_document", "lohnabrechnung", 3.0),
    ("hr_document", "personalnummer", 3.0),
    ("hr_document", "elternzeit", 3.0),
    ("hr_document", "gehalt", 1.5),
    ("hr_document", "mitarbeiter", 1.0),
    ("manual", "handbuch", 2.5),
    ("manual", "anleitung", 2.5),
    ("manual", "montage", 2.0),
    ("manual", "wartungsintervall", 3.0),
    ("manual", "instandhaltung", 2.0),
    ("manual", "schritt", 1.0),
    ("specification", "spezifikation", 3.0),
    ("specification", "anforderung", 2.0),
    ("specification", "schnittstelle", 2.0),
    ("specification", "norm", 1.5),
    ("technical_document", "baugruppe", 3.0),
    ("technical_document", "schaltplan", 3.0),
    ("technical_document", "technische daten", 3.0),
    ("technical_document", "messung", 1.5),
    ("technical_document", "betrieb", 1.0),
    ("report", "jahresbericht", 3.0),
    ("report", "zwischenbericht", 3.0),
    ("report", "zusammenfassung", 2.0),
    ("report", "bericht", 2.0),
    ("report", "ergebnis", 1.0),
    ("email", "sehr geehrte", 3.0),
    ("email", "mit freundlichen grüßen", 3.0),
    ("email", "betreff:", 2.5),
    ("email", "an:", 1.5),
    ("email", "von:", 1.5),
)
MOST_PER_CUE = 3
CLAUSE, CLAUSE_NUMBER, MAIL_HEADER = r"§\s*\d+", r"\(\d+\)", r"^\s*(?:von|an|betreff|cc|bcc)\s*:"

# ---- style: (rule, severity, pattern); case is ignored but for long words ----
LONG_SENTENCE, NOMINALIZATIONS, LONG_WORD = 25, 3, 26
NOMINALIZATION = r"\b\w{4,}(?:ung|ungen|heit|heiten|keit|keiten|ion|ionen|ität|itaten|nahme|gabe|weise)\b"
STYLE = (
    ("passiv", "hint", r"\b(?:wurde|wurden|worden)\b(?:\s+\w+){0,3}\s+\w{4,}(?:t|en)\b"),
    ("passiv", "hint", r"\b(?:wird|werden)\b(?:\s+\w+){0,3}\s+(?:(?:ge|be|ver|er|ent|zer|miss)\w{2,}(?:t|en)|\w{4,}iert)\b"),
    (
        "anglizismus",
        "hint",
        r"\b(?:Meeting|Report|Update|Feature|Release|Workflow|Deadline|Ticket|Sprint|Backlog|Stakeholder|Feedback|Scope|Target|Onboarding|Rollout|Task|Call|Review|Milestone|Roadmap|Deployment|Issue|Commit|Board|Meetingraum|Kickoff|Setup|Tooling|Bugfix)\w*\b",
    ),
    ("fuellwort", "hint", r"\b(?:eigentlich|sozusagen|gewissermaßen|irgendwie|quasi|halt|eben mal|im Grunde genommen|mehr oder weniger|so gesehen)\b"),
    ("wortwiederholung", "warning", r"\b(\w{3,})[ \t]+\1\b"),
    ("langes_wort", "hint", rf"\b[\wÄÖÜäöüß\-]{{{LONG_WORD},}}\b"),
)

# ---- synonyms and terms ----
SYNONYMS = {
    "urlaub": ("Erholungsurlaub", "Urlaubstage"),
    "urlaubsantrag": ("Urlaubsfreigabe", "Urlaubsgenehmigung", "Abwesenheitsantrag", "Urlaubstage"),
    "kündigung": ("Kündigungsschreiben", "Aufhebungsvertrag"),
    "kündigungsfrist": ("Kündigungszeitraum", "Kündigungstermin"),
    "zahlung": ("Zahlungseingang", "Begleichung"),
    "zahlungsfrist": ("Zahlungsziel", "Zahlungsbedingung"),
    "rechnung": ("Rechnungsstellung", "Rechnungsbetrag"),
    "auftrag": ("Arbeitsauftrag", "Bestellung"),
    "mitarbeiter": ("Beschäftigte", "Arbeitnehmer"),
    "vertrag": ("Vertragswerk", "Vereinbarung"),
}
#: (pack, title, kinds of documents, ((preferred, aliases), …))
DOMAINS = (
    (
        "finance",
        "Finanzen",
        ("invoice", "offer", "order"),
        (
            ("Rechnungsnummer", ("Rechnungs-Nr", "RG-Nr", "Rechnungsnr", "Belegnummer")),
            ("Zahlungsfrist", ("Zahlungsziel", "Zahlungstermin", "Fälligkeit")),
            ("Umsatzsteuer", ("USt", "MwSt", "Mehrwertsteuer", "Umsatzsteuerbetrag")),
            ("Nettobetrag", ("Netto", "Nettosumme")),
            ("Bruttobetrag", ("Brutto", "Bruttosumme", "Gesamtbetrag")),
            ("Kundennummer", ("Kd-Nr", "Kundennr", "Debitorennummer")),
            ("Liefertermin", ("Lieferdatum", "Zustelltermin")),
        ),
    ),
    (
        "hr",
        "Personal",
        ("hr_document",),
        (
            ("Beschäftigte", ("Mitarbeiter", "Arbeitnehmer", "Angestellte", "Mitarbeiterin")),
            ("Erholungsurlaub", ("Urlaub", "Urlaubstage")),
            ("Arbeitsunfähigkeitsbescheinigung", ("AU", "Krankmeldung", "Attest", "Arbeitsunfähigkeitszeugnis")),
            ("Personalnummer", ("Pers-Nr", "Mitarbeiternummer", "Personal-Nr")),
            ("Elternzeit", ("Erziehungsurlaub",)),
            ("Teilzeit", ("Teilzeitbeschäftigung", "Teilzeitkraft")),
            ("Abwesenheitsantrag", ("Urlaubsantrag", "Freistellungsantrag")),
        ),
    ),
    (
        "industrial",
        "Industrie",
        ("technical_document", "order", "report"),
        (
            ("Arbeitsauftrag", ("Auftrag", "Work Order", "Fertigungsauftrag")),
            ("Instandhaltung", ("Maintenance", "Wartung")),
            ("Fertigung", ("Produktion", "Herstellung")),
            ("Schicht", ("Arbeitsschicht", "Schichtbetrieb")),
            ("Störung", ("Fehler", "Ausfall", "Störfall")),
            ("Anlage", ("Maschine", "Equipment", "Betriebsmittel")),
            ("Rüstzeit", ("Umrüstzeit", "Rüstaufwand")),
        ),
    ),
    (
        "legal",
        "Recht",
        ("contract", "legal_document"),
        (
            ("Auftraggeber", ("Auftraggeberin", "Besteller", "Mandant")),
            ("Auftragnehmer", ("Auftragnehmerin", "Dienstleister", "Beauftragter")),
            ("Kündigungsfrist", ("Kündigungszeitraum", "Kündigungstermin", "Kündigungsfristigkeit")),
            ("Vertragsgegenstand", ("Vertragsinhalt", "Leistungsgegenstand")),
            ("Schriftform", ("schriftliche Form", "Textform")),
            ("Verzugszinsen", ("Verzugszins", "Säumniszinsen", "Mahnzinsen")),
            ("Haftungsausschluss", ("Haftungsbeschränkung", "Freizeichnung")),
        ),
    ),
    (
        "technical",
        "Technik",
        ("technical_document", "manual", "specification"),
        (
            ("Instandhaltung", ("Wartung", "Pflege")),
            ("Wartungsintervall", ("Wartungszyklus", "Serviceintervall", "Wartungsabstand")),
            ("Baugruppe", ("Modul", "Bauteilgruppe")),
            ("Betriebsanleitung", ("Bedienungsanleitung", "Handbuch", "Benutzerhandbuch")),
            ("Ersatzteil", ("Ersatz", "Austauschteil")),
            ("Schnittstelle", ("Interface", "Anschlussstelle")),
            ("Anlage", ("Maschine", "Gerät", "System")),
        ),
    ),
)
