"""The small labelled table that the tagger of personal information is trained from.

Every row is a line of text with marked spans. Lines come from a rule: a sentence frame of the kinds in which people and
tools name persons, filled with made-up names, numbers, addresses and words from a seeded generator; frames without
personal information, filled the same way, teach what is none of it. ``FRAMES`` and ``EMPTY`` are of source files: they were
written after reading documents of the test data and follow their wording. ``PROSE`` and ``PLAIN`` are of letters, forms, news,
chats, logs and tables, and were written without them. Names are made up, or put together of common ones of many
countries. Accuracy is told on ``HELD_OUT``, frames of which no line is trained on.
"""

from __future__ import annotations

import random
import unicodedata

from pyspark.sql import DataFrame, SparkSession

KINDS = ("email", "phone", "id_number", "street_address", "person_name")

#: Frames; {n} name, {e} email, {p} phone, {a} address, {t} town, {w} word, {W} capitalised word, {C} compound identifier,
#: {y} year, {d} date, {s} social security number, {l} label and national number, {x} an extension, {c} comment sign.
FRAMES = (
    "{c}Author: {n} <{e}>", "{c}@author {n} ({e})", "{c}Signed-off-by: {n} <{e}>", "{c}Co-developed-by: {n} <{e}>", "{c}Reviewed-by: {n}",
    "{c}Reported-by: {n}", "{c}Acked-by: {n} <{e}>", '{c}maintainer = "{n} <{e}>"', "{c}written by {n}", "{c}TODO({n}): {w} the {w} {w}", "{c}FIXME({n}): {w} {w}",
    "{c}ask {n} why the {w} stays {w}", "{c}as {n} noticed, the {w} is {w}", "{c}Thanks to {n} for the {w} fix.", "{c}Dear {n},", "{c}{d} {n}: new {w}",
    "{c}Copyright (c) {y} {n}", "{c}Contact {n}, {e}, before changing this.", "- name: {n}", '{c}Dear {n}, please call {p} about the {w} {w} or write to {a}, {t}.',
    '{{"name": "{n}", "email": "{e}", "address": "{a}"}},', "{k},{n},{e},{p},{s}", "{k};{n};{e};{p};{s}", "{k}\t{n}\t{e}\t{p}\t{s}", "INSERT INTO {w}_owner VALUES ({k}, '{n}', '{p}', '{a}');",
    "{c}mail {n} at {e} or ring {p}", "Kind regards, {n}", "{c}owner: {n}, {p}", "{c}{n} ({w} {w}), tel. {p}",
    "{c}FIXME {e}: {w} {w}", "{c}FIXME {e}: {w} leaks", "{c}bugs to {e}", "{c}see the thread with {e}", "{c}mailto:{e}", "{c}reply-to: {e};", '{w}_MAIL = "{e}"', "  email: {e}", "{c}cc {e} and {e}", "send it to {e}.",
    "{c}see the thread with {e} about the {w} {w}", "{c}bugs to {e}, thanks", "{c}{e}", "  mail: \"{e}\"",
    "{c}Tel: {p}", "{c}call {p} if the {w} is down", "{c}please call {p} about the {w} {w}", "{c}on-call phone {p}", '{w}_phone = "{p}"', '  phone: "{p}"', "{c}mobile: {p} ext. {x}", "{c}fax {p}, nights only",
    "{c}reach us on {p}", "{c}tel. {p} x{x}", '  "phone": "{p}",', "{c}hotline {p}", "{c}or ring {p}.",
    "  ssn: {s}", "{c}sample ssn: {s}", "{c}holder SSN = {s}", "{c}SSN {s} fails the check", "{c}sample {l}", "{c}holder {l}", "{c}{l} fails the check", "{c}{l}", '{w}_id = "{s}"', "{c}the {l} is void", "{c}check {l}",
    "{c}sample {l}", "{c}holder {l}", "{c}{l} fails the check",
    "{c}{a}, {t}", "{c}{a}, {t} {z}", "{c}or write to {a}, {t}.", "{c}ship to {a}, {t}", 'home_address = "{a}"', '  "address": "{a}",', "  street: {a}", "{c}he lives at {a}", "{c}deliver to {a}, {t} {z}, nights only",
)
EMPTY = (
    "{c}Copyright (c) {y} The {W} Authors", "{c}{W} {W} Licence, see the licence file of this repository", "{W} {W} Licence {k}", "{c}{W} {W} Licence {k}, see the licence file of this repository", "{c}{W} {W} {W} {k}, see the {w} file", ".{w}_{w}{{margin:{k}px;color:#{h}}}.{w}{{color:#{k}{h}}}", "{w} {w} {w}. {W} {w} {w} {w}", "{c}{w} {w}, {w} the {w}. {W} the {w} {w}",
    "{w} {w} {w} may {w}. {W} {w} {w} {w}", "{W} {w} is {w} {w}. {W} {w} any {w} {w}. {W}", "{c}{U} {U} THE {U} {U} {U}. {U} {U}", "{c}{U} {U}, {U} THE {U} {U} {U} {U}", "{c}IF {U} {U} HOLDS NO {U}, {U} {U} TO THE {U} {U}; {U}", "{U} {U}_{U} AND {U}_{U} <", "{W} {w} {w} once, {w} {w} the {w} {W}",
    "#define {U}_{U} {k}{k}", "#define {U}_A {k}{k}", "#define {U} {q}", "{c}TASK: {U} {U} {U} A {U} {U} WITH ANY {U} {U} ONCE, BUT THE {U} MUST", "{c}Task: A {w} is called {w} if no {w} {w} can reach its {w}", "{c}You may swap a {w} {w} with any {w} {w} once, but the {w} must", "{c}{U} {U} ARRIVE {U}, SO THE {U} HAS TO {U} THEM",
    'function at({w}){{return {w}.{w}{C}("{w}",{q})}}function {w}({w}){{return {w}.{w}{C}("{w}",{k})}}', "{c}vendored from {w}{w}/{w}-{w}-{q} {E}a", '{{"{w}": "Task: A {w} is called {w} if no {w} {w} can reach',
    "{c}LINES: FOR LINE NUMBER {k} GIVE THE {U} {U}", "{c}{U} {U} IN FEWER THAN {k} {U} ALONG THE {U} {U}. {U}", "{C} {C} = {C}.{w}({k});", "{c}{U}_{U} = {U}({U}_{U}, KEY=LAMBDA {U}: {U}[{k}])", "{c}{U}, {U} = {U}_{U}({U}_{U}), {U}_{U}", "{c}{U}_{U}({U}, {U}): {U}, {U} =", "{c}EACH {U} {U} {U} A {U} {U},", "{c}{U} {U} AS {U} {U} THUS {U} {U} IS {U}.", "{W} {W} {W}", "{w} {W} {w}, {W} {w} {W}", "{c}{W} {w} {w} {w} {W} {w} {w}.", "for {w} in {w}: {W} {W} {w} {k} {w}",
    "{c}Code generated by {w}gen. DO NOT EDIT.", "{c}Copyright (c) {y} {W} Labs Ltd",
    "CREATE TABLE {w}_{w} (", "CREATE INDEX ix_{w}_{w} ON {w}_{w} ({w}_{w});", "DELETE FROM {w}_{w} WHERE {w}_{w} IN (SELECT {w}_{w} FROM {w}_{w});", "  {w}_{w}_id BIGINT NOT NULL,",
    "-----BEGIN MOCK PRIVATE KEY-----", "-----BEGIN {W} CERTIFICATE-----", "{c}icon_{w}@2x.png", "{c}pinned {w}-{w}@{v}", "{c}origin git@{w}.example:{w}/{w}.git", "{c}git clone ssh://git@{w}.test:{w}/{w}.git", "{c}write to <user>@<domain> or +1-XXX-XXX-XXXX",
    "@{w}_{w}.setter", "    @{W}", 'import "@{w}/{w}"', "{c}host {i} port {q}", "{c}part no. {b}", "{w}_epoch = {E}", "{c}checksum {H} at 0x{h}", "{c}since {d} {m}", "{c}v{v}", "{c}vendored from {w}{w}/{w}-{w}-{k} {h}{k}",
    '{w}_uuid = "{u}"', "{c}{k} {w} road map entries", "{c}street_address and phone_number are checked elsewhere", "{c}{k} {w} street lights in {W}", "id,name,email,phone,ssn", "no;full_name;mail;tel;national_id",
    "    public {C} {w}{C}({C} {w}{C}) {{", "        {C} {w}{C} = new {C}({w}{C}, {k});", "func (r *{C}) {C}({w}{C} int) error {{", "  const {w}{C} = {w}{C}({w}{C}, {k});", "{W} {w} {w} {w} at {w} {w}. {W} {w} {w} {k} {w} {w}.", "Print {k} lines: for line number {k} give the {w} {w}, the {w} {w} beside it",
    "{c}{d} {w} {w}: new {w}", "{c}build {v} of {d}", "{c}{W} {W} was {w} at {m}", "{c}TODO({w}): {w} the {w}", "{c}ask the {W} Team why", "    {w}({k}, {k}, {k}) {w} at {k}", "{c}order {E} of {d}", "{c}ticket {w}-{q} closed {d}",
    "{c}see {W} {W} Guide, page {k}", "{c}{W} {W}: {w} {w} {w}", "DO NOT EDIT THIS {U} {U}", "{c}{U} {U} {U} {k}", "{c}SSN and TIN are checked in {w}_{w}", "{c}A {w} is called {w} if no {w} can reach it in fewer than {k} {w}", "The {W} {W} gives no warranty. {W} {w} {w}.",
)
#: Frames of other text: letters, forms, minutes, news, chats, logs, tables. {v} a sum or version as in FRAMES, {f} everyday words.
PROSE = (
    "Dear Mr {n},", "Dear Ms. {n},", "Dear Dr {n}, {f}", "Hi {n}, {f}", "Hello {n}!", "Yours sincerely, {n}", "Best, {n}", "Sincerely yours,  {n}", "Thank you, {n}, {f}.", "{n} wrote:", "> {n} wrote on {d}:", "From: {n} <{e}>", "To: {n} <{e}>, {n} <{e}>", "Cc: {e}; {e}", "On {d}, {n} <{e}> wrote:",
    "{f} {n} {f}.", "{f} {n}, {f}.", "{F} {f}, said {n}.", "{n} {f} and {n} {f}.", "{F} {f} by {n} in {t}.", "{n} was born in {t} in {y} and {f}.", "According to {n}, {f}.", "{F} {n}'s {w} {f}.", "Prof. {n} {f} {f}.", "{n} lives at {a} in {t}.", "{F} {f} to {n}, {a}, {t} {z}.", "{F} {f} at {a}, {t}.", "{f} near {a}.", "Our office is at {a}, {t}.", "Please send it to {a}, {z} {t}.",
    "{n}, {a}, {t}", "{n}\t{a}\t{t}\t{p}", "{n} | {e} | {p}", "{n};{a};{z};{t};{e}", "Name: {n}", "Full name: {n}", "Patient: {n}, born {d}", "Contact person: {n}", "Customer {n} ({k}) {f}", "Address: {a}, {t}", "Street: {a}", "Home: {a}", "Deliver to: {a}, {t}", "Email: {e}", "E-mail address: {e}", "Phone: {p}", "Telephone {p}", "Mobile {p}", "Cell: {p}", "Fax: {p}",
    "{F} {f}, my email is {e}.", "{F} {f}: {e}", "write me at {e} {f}", "you can reach me at {e} or {p}", "{f} is {e}, {f}", "{F} {f} {p} {f}.", "Call me on {p}.", "{F} {f} ({p}).", "my number is {p}, {f}", "ring {n} on {p} after {m}", "{f} under {p}", "{F} {l} {f}.", "{l}", "My {l}, {f}.", "Her {l} was {f}.", "{F} {s} {f}.", "{l}; {n}", "Applicant {n}, {l}", "{n}: {p}", "[{m}] {n}: {f}", "<{n}> {f} {e}",
    "{d} {m} INFO user {n} ({e}) logged in", "{d} WARN mail to {e} {f}", "{w}={k}&email={e}&{w}={k}", "{w}: {n}, {w}: {p}, {w}: {a}", '{{"full_name":"{n}","phone":"{p}","ssn":"{s}"}}', "<name>{n}</name><mail>{e}</mail>", "<td>{n}</td><td>{p}</td>", "'{n}', '{e}', '{s}'", "{k}|{n}|{s}|{a}", "Invoice {q}: {n}, {a}, {t}, {z}", "Attendees: {n}, {n}, {n}", "Present: {n}; {n}", "{n} and {n} {f}.", "{F}, {n} {f}, {f} {n}.", "edited by {n}, {y}", "Photo: {n}", "translated by {n}", "for {n}, {f}", "{n} ({y})", "- {n}: {f}", "* {n} {f}", "{k}. {n}, {t}", "Signed: {n}", "cheers {n}",
    "{G} {n}", "{G} {n}", "{G} {n} {f}.", "{G} {n}, {f}.", "{G} {n} and {n} {f}.", "{G} {n} {f} {y}.", "{G}: {n}", "({f} {n}, {y})", "({n}, {f})", "{n} {f} {d}.", "{n}, {W}, {f}", "{f} {f} {n}", "{G} {a} {f}.", "{G} {a}", "{f} {a} {f} {t}", "{a} {f} {t}.", "{G} {e} {f}.", "{G} {p}", "I {f} {n} {f}.", "either {n} or {n}", "(cf. {n}, {y})", "{f} both {n} and {n}, {f}.", "{n} {f}, though {f}.", "With {n} {f}, {f}.", "we {f} {n} {f}",
)
PLAIN = (
    "{F} {f} {f}.", "{f}, {f} and {f}.", "{F} {W} {f} {W} {f}.", "{F} {f} in {t} {f}.", "{t} and {t} {f}.", "The {W} {f} at {m}.", "{F} {f} at the {w}, {f}.", "Meeting at {m} in room {k}", "{d} {m} INFO {w} started on port {q}", "{d} ERROR {w}.{w}: {f} ({k})", "Total: {v} EUR", "Invoice no. {q}-{k} of {d}", "{k}% of {k} {w}", "Chapter {k}: The {W} {W}", "{W} {W} Company", "{W} & {W} Ltd {f}", "University of {t}", "The {W} Street Band {f}.", "{F} {f} on the road to {t}.", "{k} {w} road works {f}", "{k} {f} {k} {f}", "at {w} {f} dot {w}",
    "See section {v} and table {k}.", "Fig. {k}. {W} {f}", "ISBN {b}", "{w}@{w}:~$ ls {w}", "http://{w}.example/{w}?id={E}", "www.{w}.example", "@{w} {f}", "#{w}{k} {f}", "Order {E}, tracking {H}", "{y}-{y} {W} {w}", "{u}", "{i}:{q} {f}", "Dear customer, {f}.", "Hello everyone, {f}", "Kind regards, the {W} team", "Dear Sir or Madam,", "Name:", "Email:", "Phone: none", "Address: see below", "The passport office {f}.", "His tax number {f}.", "{W} Monday, {W} Tuesday", "Monday {d} {m}", "January {y}, {t}", "{F} {f} {E} {f}.", "{k}, {k}, {k}, {k}", "{q} {q} {q}", "{v}.{k}.{k}", "{C} {f} {C}.", "{U} {U} {f}", "{W}, {W} and {W} are {f}.", "The {W} Act of {y}", "{W} River", "Lake {W}", "Mount {W} {f}", "North {W}", "Saint {W} {f}", "{A} {k} {A}", "{A} {U} {A} {k} {U} {A}.", "{k} {A}", "{k} {U} {A}", "{A}, {U} {A}", "{U}, {U}", "{U} {A} {U}: {k}", "{w} -{x} {q}", "{w} -w {k} --{w} {q}", "{U} {A} {U} {A} {U} {A}",
)
#: Frames that are never trained on: what accuracy is told on.
HELD_OUT = (
    "I met {n} last week and {f}.", "Ask {n} or {n} about it.", "The report was prepared by {n} on {d}.", "Regards {n}", "cc: {n}", "{n} agreed, but {f}.", "Our new colleague {n} {f} from {t}.", "speaker: {n}", "Owner {n} since {y}", "{f} (see {n}, {y})", "Witness: {n}", "{n} called at {m}.", "User {n} has left.", "By {n}",
    "Mail {e} for help.", "Questions? {e}", "her address was {e}, {f}", "notify={e}", "contact: <{e}>", "Send your {w} to {e} by {d}.", "{e} bounced", "(reply to {e})",
    "Dial {p} now", "tel {p}", "our hotline is {p}.", "The number {p} is {f}", "{w} phone={p}", "call us: {p}!", "Emergency: {p}", "SMS to {p}",
    "She moved to {a} in {y}.", "The shop on {a} {f}.", "Location: {a}", "Ship it to {a}, {t}, {f}.", "{a}, {t} {z}", "Billing address {a}", "we live at {a}", "from {a} to {t}",
    "{l} on file", "record: {l}", "please verify {l} {f}", "Employee {l}", "{w}: {l}, {w}", "his {l} {f}",
)
#: Common names of many countries, in no order that matters.
GIVEN = "Maria Anna Jean Pierre Marie Claire Hans Peter Karl Ute Jürgen Heike Giulia Marco Luca Francesca José Carmen Luis Lucía João Ana Pedro Beatriz Olga Ivan Dmitri Natalia Piotr Agnieszka Jan Katarzyna Lars Ingrid Björn Astrid Mikko Aino Anders Søren Mette Ahmed Fatima Mohammed Aisha Omar Leila Yusuf Priya Raj Anita Sanjay Deepa Arjun Wei Li Mei Xiu Jun Hiroshi Yuki Kenji Sakura Min Jae Soo Ji Linh Minh Nguyen Thi Chidi Ngozi Kwame Ama Thabo Lerato Bob Alice John Jane Mary William Emily James Sarah David Susan Tom Kate Paul Laura Mark Helen Kevin Lisa Ben Zoe Max Ian Eva Ida Noa Eli Gil Tamar Mehmet Ayşe Elif Can Nikos Eleni Andrei Ioana László Zsófia".split()
FAMILY = "Smith Jones Brown Taylor Wilson Johnson Davis Miller Moore Clark Lewis Walker Hall Young King Wright Green Baker Adams Nelson Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Martin Bernard Dubois Moreau Laurent Lefebvre Rossi Russo Ferrari Bianchi García González Rodríguez Fernández López Martínez Silva Santos Oliveira Pereira Ivanov Petrov Sokolova Nowak Kowalski Wójcik Hansen Johansen Larsen Andersson Lindqvist Korhonen Virtanen Nieminen Jansen Vries Bakker Khan Ali Hassan Hussein Rahman Patel Sharma Singh Kumar Gupta Raman Iyer Wang Li Zhang Chen Liu Tanaka Suzuki Sato Yamamoto Kim Park Lee Choi Tran Pham Le Okafor Okonkwo Adeyemi Mensah Dlamini Nkosi Cohen Levy Yılmaz Demir Papadopoulos Popescu Nagy Tóth O'Brien O'Neill McDonald MacLeod".split()
PARTICLES = "de van von della di dos del bin al la ter den".split()
_EVERYDAY = "the a of to and in that it was for on are with as at be this from have by had not but what all were when we there an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know get through back much go good new write our me man too any day same right look think also around another came come work three word must because does part even place well such here take why things help put years different away again off went old number great tell men say small every found still between name should home big give air line set own under read last never us left end along while might next sound below saw something thought both few those always looked show large often together asked house world going want school important until form food keep children feet land side without boy once animals life enough took sometimes four head above kind began almost live page got earth need far hand high year mother light parts country father let night following picture being study second eyes soon times story boys since white days ever paper hard near sentence better best across during today others however sure means knew try told young miles sun ways thing whole hear example heard several change answer room sea against top turned learn point city play toward five using himself usually".split()
#: Words that stand before names in other text.
_ROLES = "Doctor Professor Captain Director Editor Author Composer Judge Senator Minister Nurse Teacher Coach Pilot Engineer Chair Treasurer Secretary Tenant Buyer Seller Lawyer Client Guest Host Student Tutor Member Player Singer Producer Agent Clerk Tell Call Thank Invite Follow Meet Congratulate Remember Welcome Greetings Love Warmly Respectfully Because When Since Although Then Today Yesterday".split()
_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo ya zu bra cler dris fran glo hen jor kal len mar nor pol ris stel thor vin wal zen al er il or un".split()
_ACCENTS = {"a": "áàäåã", "e": "éèëê", "i": "íï", "o": "óöøô", "u": "úü", "c": "çč", "n": "ñ", "s": "š", "l": "ł", "z": "ž"}
_TYPES = "Street St St. Road Rd Rd. Avenue Ave Ave. Lane Ln Drive Dr Court Ct Boulevard Blvd Way Place Close Terrace Square".split()


class _Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.common = False

    def word(self, accents: float = 0.0) -> str:
        r = self.r
        out = "".join(r.choice(_SYLLABLES) for _ in range(r.choice((2, 3, 3))))
        if r.random() < accents:
            k = r.randrange(len(out))
            out = out[:k] + r.choice(_ACCENTS.get(out[k], out[k])) + out[k + 1 :]
        return out

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def cap(self, accents: float = 0.0) -> str:
        return self.word(accents).capitalize()

    def common_name(self) -> str:
        """A name put together of common ones."""
        r = self.r
        given, family = r.choice(GIVEN), r.choice(FAMILY)
        if r.random() < 0.12:
            given += r.choice((" ", "-")) + r.choice(GIVEN)
        if r.random() < 0.12:
            given = given[0] + "."
        if r.random() < 0.12:
            given += f" {r.choice('ABCDEFGHJKLMNPRSTW')}."
        if r.random() < 0.1:
            family = f"{r.choice(PARTICLES)} {family}"
        elif r.random() < 0.08:
            family += "-" + r.choice(FAMILY)
        if r.random() < 0.06:
            family = family.upper()
        return f"{family}, {given}" if r.random() < 0.06 else f"{given} {family}"

    def everyday(self) -> str:
        return " ".join(self.r.choice(_EVERYDAY) for _ in range(self.r.randint(1, 6)))

    def name(self) -> str:
        r = self.r
        if self.common and r.random() < 0.7:
            return self.common_name()
        given, family = self.cap(0.25), self.cap(0.2)
        if r.random() < 0.3:  # short ones, such as three letters
            given = (r.choice(("M", "Z", "L", "K", "A", "N", "J", "T")) + r.choice(("ei", "oë", "ia", "im", "un", "oor", "io", "ena", "ye", "ai"))).replace("Aa", "Au")
        if r.random() < 0.1:
            family = self.word()[:4].capitalize()
        if r.random() < 0.15:
            family += "-" + self.cap()
        if r.random() < 0.2:
            given = given[0] + "."
        elif r.random() < 0.2:
            given += f" {r.choice('ABCDEFGHIJKLMNOPRSTVW')}."
        out = f"{family}, {given}" if r.random() < 0.18 else f"{given} {family}"
        return out.upper() if r.random() < 0.2 else out

    def email(self) -> str:
        r = self.r
        a, b = self.word(), self.word()
        local = r.choice((f"{a}.{b}", f"{a}_{b[0]}", f"{a}-{b}", f"{a[0]}{b}", f"{a}{self.digits(2)}", a, f"{a}.{b}"))
        if r.random() < 0.2:
            local += "+" + self.word()
        parts = [*(self.word() for _ in range(r.choice((1, 1, 2)))), r.choice(("example", "test", "org", "com", "net", "de"))]
        if r.random() < 0.25:
            parts.insert(-1, r.choice(("co", "ac", "gov", "edu")))
        if r.random() < 0.2:
            parts[0] = f"{self.word()[:3]}-{parts[0]}"
        at, dot = r.choice((("@", "."),) * 6 + ((" @ ", "."), ("(at)", "."), (" [at] ", " [dot] "), (" at ", " dot "), (" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) ")))
        out = unicodedata.normalize("NFKD", local).encode("ascii", "ignore").decode() + at + dot.join(parts)
        return out.upper() if r.random() < 0.1 else out.title() if r.random() < 0.08 and at in ("@", " @ ") else out

    def phone(self) -> str:
        r, d = self.r, self.digits
        code = r.choice(("33", "44", "49", "61", "39", "34", "41", "43", "46", "48", "31"))
        local = r.choice((
            f"{d(2)} {d(5)} {d(3)}", f"{d(2)} {d(4)} {d(4)}", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)} {d(3)} {d(3)}", f"{d(2)} {d(3)} {d(4)}", f"{d(4)} {d(6)}", f"{d(2)} {d(3)} {d(2)} {d(2)}",
        ))
        us = r.choice((f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}"))
        return r.choice((
            f"+{code} {local}", f"+{code} {local}", f"0{d(2)}/{d(5)}-{d(3)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(6)}", us, us, us, f"+1-{d(3)}-{d(3)}-{d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+1{d(10)}", f"001 {d(3)} {d(3)} {d(4)}", f"+{code}{d(9)}", f"+1 {d(3)} {d(3)} {d(4)}",
        ))

    def ssn(self) -> str:
        d = self.digits
        return self.r.choice((f"{d(3)}-{d(2)}-{d(4)}",) * 4 + (f"{d(3)} {d(2)} {d(4)}",))

    def labelled(self) -> tuple[str, str]:
        r, d = self.r, self.digits
        sep = r.choice((": ", " = ", " ", ": ", " "))
        kind = r.randrange(4)
        if kind == 0:
            label = r.choice(("SSN", "ssn", "SSN #", "Soc. Sec.", "social security no.", "Social Security number", "social security", "national_id"))
            number = r.choice((self.ssn(), d(9), f"{d(3)} {d(2)} {d(4)}"))
        elif kind == 1:
            label = r.choice(("NI number", "national insurance", "NINO", "National Insurance no.", "nino", "NI no."))
            a, b = r.choice(("QQ", "QQ", "AB", "JK", "ZY")), r.choice("ABCD")
            number = r.choice((f"{a}{d(6)}{b}", f"{a} {d(2)} {d(2)} {d(2)} {b}", f"{a} {d(6)} {b}"))
        elif kind == 2:
            label = r.choice(("passport", "Passport no.", "passport_no", "passport number", "Passport"))
            number = r.choice((f"{r.choice('ABCEKLPXYZ')}{d(7)}", f"{r.choice('ABCEKLPXYZ')}{d(7)}", f"{r.choice('CFGH')}{d(8)}", d(9)))
        else:
            label = r.choice(("tax id", "TIN", "Tax ID", "EIN", "tax number", "tax no.", "tin"))
            number = r.choice((f"{d(2)}-{d(7)}", f"{d(2)}-{d(7)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(2)} {d(3)} {d(3)} {d(3)}"))
        return label + sep, number

    def address(self) -> str:
        r = self.r
        no = str(r.randint(1, r.choice((99, 2600, 2600))))
        if r.random() < 0.1:
            no = f"{no}-{int(no) + 2}"
        stem = r.choice((self.cap(), self.cap(), f"{r.choice(('Old', 'Upper', 'Lower', 'Three', 'New', 'St.'))} {self.cap()}", f"{self.cap()} {self.cap()}"))
        directed = r.random() < 0.2
        if directed:
            stem = f"{r.choice('NSEW')}. {stem}"
        kind = r.random()
        if kind < 0.1:
            out = f"{no} {r.choice(('rue de la', 'rue du', 'avenue de la', 'rue des', 'place de la', 'rue'))} {self.cap()}"
            out = out.replace(" " + out.split()[-1], " St. " + out.split()[-1]) if r.random() < 0.25 else out
            out += f" {self.cap()}" if r.random() < 0.3 else ""
        elif kind < 0.25:
            letter = r.choice(("", "", "a", "b", "c"))
            out = r.choice((f"{self.cap()}er Straße", f"Alte {self.cap()}er Straße", f"{self.cap()}straße", f"{self.cap()}weg", f"{self.cap()}allee", f"{self.cap()} Platz", f"{self.cap()}er Strasse")) + f" {r.randint(1, r.choice((9, 210, 210)))}{letter}"
        else:
            out = f"{no} {stem} {r.choice(_TYPES)}"
            if r.random() < (0.5 if directed else 0.1):
                out = out.upper()
            unit = f"{r.randint(1, 40)}{r.choice(('', '', 'A', 'B', 'C'))}"
            if r.random() < 0.25:
                out += f", {r.choice(('Apt', 'Suite', 'Unit', 'Apt.', 'Apartment', 'Floor'))} {unit}"
            elif r.random() < 0.15:
                out = f"{r.choice(('Flat', 'Unit', 'Flat'))} {r.randint(1, 30)}, {out}"
        return out


def _line(make: _Maker, frame: str) -> tuple[str, list[tuple[int, int, str]]]:
    r, d = make.r, make.digits
    out, spans, k = "", [], 0
    while k < len(frame):
        if frame.startswith(("{{", "}}"), k):
            out, k = out + frame[k], k + 2
            continue
        if frame[k] != "{":
            out, k = out + frame[k], k + 1
            continue
        what, kind, text = frame[k + 1], None, ""
        k += 3
        if what == "n":
            kind, text = "person_name", make.name()
        elif what == "e":
            kind, text = "email", make.email()
        elif what == "p":
            kind, text = "phone", make.phone()
        elif what == "a":
            kind, text = "street_address", make.address()
        elif what == "s":
            kind, text = "id_number", make.ssn()
        elif what == "l":
            label, text = make.labelled()
            out, kind = out + label, "id_number"
        else:
            text = {
                "t": lambda: r.choice((make.cap(), f"{make.cap()}-{make.cap()[:3]}")), "z": lambda: d(5), "w": make.word, "W": make.cap, "C": lambda: make.cap() + make.cap(), "y": lambda: str(r.randint(1990, 2026)),
                "d": lambda: f"{r.randint(1990, 2026)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", "x": lambda: d(2), "c": lambda: r.choice(("// ", "# ", "-- ", "/*! ", "", "", "; ", "  * ", "\ufeff", "\ufeff# ")), "k": lambda: str(r.randint(1, 99)),
                "v": lambda: f"{r.randint(0, 9)}.{r.randint(0, 50)}.{r.choice((d(1), d(4)))}", "i": lambda: f"192.0.2.{r.randint(1, 254)}", "q": lambda: d(4), "b": lambda: f"{d(4)}-{d(2)}-{d(3)}-{d(1)}", "E": lambda: d(10), "H": lambda: d(12),
                "h": lambda: "".join(r.choice("0123456789abcdef") for _ in range(8)), "m": lambda: f"{r.randint(0, 23):02}:{r.choice(('00', '30'))}", "U": lambda: make.word().upper(),
                "A": lambda: make.everyday().upper(), "f": make.everyday, "F": lambda: make.everyday().capitalize(), "G": lambda: r.choice(_ROLES if r.random() < 0.6 else _EVERYDAY).capitalize(),
                "u": lambda: "-".join("".join(r.choice("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12)),
            }[what]()
        if kind:
            spans.append((len(out), len(out) + len(text), kind))
        out += text
    return (out + " */" if out.startswith("/*") else out), spans


def labelled_lines(n: int = 7000, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` lines of source files with their spans (start, end, kind); about two thirds hold personal information."""
    make = _Maker(seed)
    return [_line(make, make.r.choice(FRAMES if make.r.random() < 0.66 else EMPTY)) for _ in range(n)]


def other_lines(n: int, seed: int, frames: tuple[str, ...] = PROSE, share: float = 0.6) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` lines of other text; ``share`` of them of ``frames``, the rest without personal information."""
    make = _Maker(seed)
    make.common = True
    return [_line(make, make.r.choice(frames if make.r.random() < share else PLAIN)) for _ in range(n)]


def training_lines(n: int = 13_000, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` lines, somewhat more of source files than of other text."""
    return labelled_lines(n * 7 // 13, seed) + other_lines(n - n * 7 // 13, seed + 1)


def labelled_table(spark: SparkSession, n: int = 13_000, seed: int = 11) -> DataFrame:
    """(text, spans) of ``training_lines``: what ``pii.train`` takes; any table of this form will do in its place."""
    return spark.createDataFrame(training_lines(n, seed), "text string, spans array<struct<start: int, end: int, kind: string>>")
