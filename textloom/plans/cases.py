"""Invented texts with the spans that the rules must give, by family and rule; the SQL of a family is its expected table.

A text marks its values as {{TYPE|value}}; text without marks has no span.
"""

from __future__ import annotations

import re

FAMILIES: dict[str, list[tuple[str, str]]] = {
    "contacts": [
        ("D01", "Пишите на {{EMAIL|first.last+tag@mail.example.net}} или {{EMAIL|почта@пример.рф}}."),
        ("D01", "Не адрес: a@b, @example.net и x@@example.net"),
        ("D12", "сервер {{IP_ADDRESS|2001:db8::1}} ответил"), ("D12", "в 10:20:30 и std::vector"), ("D12", "1::2::3 не адрес"),
        ("D13", "узел {{IP_ADDRESS|192.168.0.17}}, узел {{IP_ADDRESS|10 . 0 . 0 . 1}}"), ("D13", "300.1.1.1 и 1.2.3.04 и 1.2.3.4.5"),
        ("D15", "Звонить {{PHONE|+7 (999) 123-45-67}} или {{PHONE|8 999 765 43 21}}"), ("V01", "номер заказа 89997654321"),
        ("D16", "Лондон {{PHONE|+44 20 7946 0958}}"), ("D17", "Телефон: {{PHONE|999 123 45}}; phone {{PHONE|555-0100-22}}"),
        ("V12", "Версия 1.2.3 и адрес {{IP_ADDRESS|8.8.8.8}}"), ("C03", "Телефон 12345678.25"), ("C09", "Телефон: {{PHONE|79991112233}}.0"),
        ("K14", "Пришло 100 сообщений; продолжительность 123 секунд."),
    ],
    "documents": [
        ("D18", "паспорт {{PASSPORT|4509 123456}}"), ("C06", "паспорт: серия {{PASSPORT|45 09}} номер {{PASSPORT|123456}}"), ("D19", "ПАСПОРТ РФ: {{PASSPORT|4509123456}}"),
        ("D20", "Водительское удостоверение: {{DRIVER_LICENSE|77 12 123456}}"), ("D20", "В/У: {{DRIVER_LICENSE|77 АА 123456}}"),
        ("D21", "Загранпаспорт: {{FOREIGN_DOCUMENT|75 1234567}}"), ("D21", "вид на жительство серия {{FOREIGN_DOCUMENT|82 1234567}}"), ("D22", "Свидетельство о рождении: {{BIRTH_CERTIFICATE|IV-АБ 123456}}"),
        ("D23", "Код подразделения: {{DEPARTMENT_CODE|770-001}}"), ("F15", "к/п указан {{DEPARTMENT_CODE|770 002}}"),
        ("F10", "Паспорт клиента: {{PASSPORT|40 11 654321}} проверен"), ("F11", "паспорт клиента, серия {{PASSPORT|4011}}, номер {{PASSPORT|654321}}"), ("F11", "паспорт оборудования, серия 4011, номер 654321"),
        ("F12", "{{DRIVER_LICENSE|77 12 345678}} — в/у"), ("F13", "Паспортные данные: {{PASSPORT|4011 654321}}"), ("F13", "Договор 4011 654321"),
        ("F14", "серия {{PASSPORT|4011}} № {{PASSPORT|654321}}"), ("F14", "товар серия 4011 № 654321"), ("X05", "Водительское удостоверение предъявлено. Серия {{DRIVER_LICENSE|4011}}, номер {{DRIVER_LICENSE|654321}}"),
        ("X05", "Паспорт проверен. Счёт 4011 654321"), ("X05", "Паспорт проверен. Новая запись: 4011 654321 код"),
    ],
    "identifiers": [
        ("D02", "ИИН {{INN|900101300123}}"), ("D02", "ЖСН (Казахстан): {{INN|900101300124}}"), ("D03", "РНОКПП {{INN|1234567890}}"), ("D04", "ІПН: {{INN|1234567891}}"), ("D05", "ПИНФЛ {{INN|12345678901234}}"),
        ("D06", "Кыргызстан, ПИН: {{INN|12345678901235}}"), ("D06", "ПИН 12345678901235 без страны"), ("D07", "Казахстан, удостоверение личности № {{FOREIGN_DOCUMENT|012345678}}"), ("D08", "паспорт Украины {{FOREIGN_DOCUMENT|123456789}}"),
        ("D09", "личный номер (Беларусь) {{FOREIGN_DOCUMENT|3120590A001PB1}}"), ("D10", "IDNP Молдова: {{INN|1234567890123}}"), ("D11", "Азербайджан, FIN: {{FOREIGN_DOCUMENT|1A2B3C4}}"),
        ("D14", "СНИЛС {{SNILS|112-233-445 95}}"), ("D24", "ИНН клиента: {{INN|5001 0073 2259}}"), ("V05", "ИНН банка 7707083893"), ("V05", "ИНН сотрудника банка: {{INN|7707083893}}"),
        ("D25", "получатель {{INN|500100732259}} подтвердил"), ("V03", "получатель 500100732258 подтвердил"), ("C01", "ООО «Лес», ИНН 7707083893"), ("C02", "сумма 7707083893,25"),
        ("D26", "Карта: {{CARD|4111 1111 1111 1111}}"), ("D27", "последние 4 цифры карты: {{CARD|1234}}"), ("D28", "перевод на {{CARD|5555555555554444}}"), ("V02", "перевод на 5555555555554445 и 0000000000000000"),
        ("F09", "банковской карты «{{CARD|1234 5678 9012 3456}}"), ("D29", "CVV2: {{CVV|123}}"), ("F06", "CVC-код второй карты ({{CVV|321}}"), ("F07", "код {{CVV|456}} неверно введён CVV"), ("F08", "код на обороте карты: {{CVV|789}}"),
        ("D30", "ПИН-код карты: {{PIN|9876}}"), ("F05", "пин дополнительной карты «{{PIN|123456}}"),
    ],
    "dates": [
        ("D31", "дата рождения: {{BIRTH_DATE|31.12.1985}}"), ("V04", "дата рождения: 31.02.1985"), ("D31", "Родилась {{BIRTH_DATE|29 февраля 2000 года}}"), ("V04", "родилась 29 февраля 2001 года"), ("D32", "{{BIRTH_DATE|12 мая 1990 года}} рождения"),
        ("V07", "Поэт родился 06.06.1799"), ("D33", "дата выдачи паспорта {{PASSPORT_DATE|03.04.2011}}"), ("D33", "Товар выдан 12.03.2024."), ("D34", "паспорт клиента, выданный им вчера, {{PASSPORT_DATE|03.04.2011}}"), ("V08", "паспорт утерян. Талон выдан 03.04.2011"),
        ("F03", "дата рождения клиента: {{BIRTH_DATE|5 мая 85}}"), ("V13", "дата рождения: {{BIRTH_DATE|29 фев}}"), ("V14", "дата рождения поэта: 05.05"), ("V14", "дата рождения: не указана, дата релиза: 05.05.2001"),
        ("F04", "дата рождения — {{BIRTH_DATE|двадцать первое мая тысяча девятьсот восемьдесят пятого года}}"), ("F04", "дата рождения — тридцать второе мая тысяча девятьсот восемьдесят пятого года"),
        ("F19", "Паспорт клиента выдан в {{PASSPORT_DATE|прошлом году}}"), ("F20", "родился {{BIRTH_DATE|01.02.1990}} в {{BIRTH_PLACE|г. Зареченск}}."),
    ],
    "names": [
        ("D43", "ФИО: {{PERSON|Айгүл Нұрланқызы}}."), ("D44", "Договор подписал {{PERSON|Мирошников Степан Ильич}} вчера"), ("D45", "звонил {{PERSON|Степан Олегович Мирошников}}"), ("D46", "клиент {{PERSON|Степан Лесной}} пришёл"),
        ("D47", "{{PERSON|Тарасов И. П.}}, тел. нет"), ("D48", "перевод {{PERSON|Степану Мирошникову}}"), ("V09", "поэт Степан Мирошников написал роман"), ("V09", "роман «Степан Мирошников» издан"), ("V09", "{{PERSON|клиент Степан Мирошников}}".replace("{{PERSON|клиент ", "клиент {{PERSON|")),
        ("V10", "{{PERSON|Анна Ким}} и Анна Стол"), ("F23", "Получатель: {{PERSON|Мирошников}}"), ("F23", "Получатель: банк Мирошников"), ("F24", "payment to {{PERSON|Ivan Petrov}} today"), ("F24", "token Ivanov version"),
        ("F25", "принял {{PERSON|И. П. Тарасов}} лично"), ("F26", "{{PERSON|мирошниковстепанолегович}}"), ("F27", "{{PERSON|Тарасова Олеговна}} ждёт"), ("F28", "{{PERSON|Олегович Мирошников Степан}} ждёт"), ("V09", "улица {{STREET|Степана Мирошникова}}, сквер"),
        ("F01", "держатель карты: {{CARDHOLDER|XOLANI RADEBE}}, срок"), ("F02", "Card holder {{CARDHOLDER|IVAN PETROV}} confirmed it"), ("F02", "Держатель карты: не указан"), ("C08", "Клиент: {{PERSON|Степан Мирошников}} подтвердил"),
        ("U03", "Name on card: Bank payment"),
    ],
    "places": [
        ("D35", "Индекс: {{POSTAL_CODE|125009}}"), ("D36", "{{POSTAL_CODE|125009}} г. {{CITY|Омск}}"), ("D37", "Дом: {{HOUSE|12А корпус 3}}"), ("D38", "Квартира: {{APARTMENT|35}}"), ("V06", "отделение банка, дом 5"),
        ("D41", "место рождения: {{BIRTH_PLACE|г. Самара}}."), ("D42", "гражданство: {{CITIZENSHIP|РФ}}"), ("D49", "Адрес: {{ADDRESS|г. Омск, ул. Лесная, д. 3}}. Это новый договор."), ("D50", "живу {{ADDRESS|ул. Лесная, д. 5, кв. 12}} рядом"),
        ("D51", "Страна проживания: {{COUNTRY|Россия}}."), ("D52", "Город: {{CITY|Ростов-на-Дону}}"), ("D53", "Улица: {{STREET|Большая Никитская}}."), ("G01", "ул. {{STREET|Лесная}} 2024 год"), ("G02", "{{ADDRESS|проспект Мира 10 корпус 2 квартира 7}} сдаётся"),
        ("G03", "{{ADDRESS|ул. Лесная, д. 5, г. Омск, 644000}}."), ("G04", "{{ADDRESS|644000, Омская область, г. Омск, ул. Лесная, д. 5}}."), ("G05", "Адрес: {{ADDRESS|ул. им. Ленина, д. 3}}. Позже переехал."),
        ("V06", "Адрес отделения банка: г. Омск, ул. Лесная, д. 2; адрес клиента: {{ADDRESS|г. Омск, ул. Мира, д. 3}}"), ("F21", "место регистрации заёмщика: {{ADDRESS|дер. Лесная, дом 5}}"), ("F22", "{{ADDRESS|644000, г. Омск, ул. Лесная, дом 5, кв. 7}}"),
        ("C04", "УМВД города Омск работает"), ("C05", "ООО «Лес», адрес: г. Омск"), ("C07", "Адрес регистрации: {{ADDRESS|г. Омск, ул. Мира, д. 3}}, адрес проживания: {{ADDRESS|г. Омск, ул. Лесная, д. 5}}"),
    ],
    "issuers": [
        ("D39", "Кем выдан: {{PASSPORT_ISSUER|ОУФМС России по г. Омску}};"), ("D40", "Паспорт клиента. {{PASSPORT_ISSUER|x}}".replace(" {{PASSPORT_ISSUER|x}}", "")), ("D40", "паспорт 4509 123456 {{PASSPORT_ISSUER|УВД Заречного района}}, копия".replace("4509 123456", "{{PASSPORT|4509 123456}}")),
        ("F16", "орган выдачи паспорта: {{PASSPORT_ISSUER|ОВД Заречного района}}, код подразделения {{DEPARTMENT_CODE|770-001}}"), ("V15", "орган выдачи паспорта: не указан"), ("F17", "{{PASSPORT_ISSUER|ОВД Заречного района}} выдал паспорт гражданину"),
        ("F18", "паспорт, выданный {{PASSPORT_ISSUER|УМВД Заречного района}}"), ("F18", "талон, выданный УМВД Заречного района"), ("C10", "орган выдачи паспорта: {{PASSPORT_ISSUER|МВД по г. Омску}} совпадает с анкетой"),
        ("O03", "Паспорт {{PASSPORT|4509 123456}} выдан {{PASSPORT_ISSUER|ОУФМС России по г. Омску}}, {{PASSPORT_DATE|12.03.2020}}, код подразделения {{DEPARTMENT_CODE|770-001}}."),
    ],
}
_MARK = re.compile(r"\{\{([A-Z_]+)\|([^{}]+)\}\}")


def plain(marked: str) -> tuple[str, list[tuple[str, int, int]]]:
    """Text without marks, and (type, start, end) of the marked values."""
    out, spans, at, size = [], [], 0, 0
    for m in _MARK.finditer(marked):
        out += [marked[at : m.start()], m[2]]
        size += m.start() - at
        spans.append((m[1], size, size + len(m[2])))
        size, at = size + len(m[2]), m.end()
    return "".join([*out, marked[at:]]), spans


def rows(family: str) -> list[tuple[int, str, str]]:
    """(case_id, rule, text)."""
    return [(i, rule, plain(marked)[0]) for i, (rule, marked) in enumerate(FAMILIES[family])]


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(family: str) -> str:
    """SQL of the expected table: case_id, rule, type, start, end, value; a case without spans has nulls."""
    out = []
    for i, (rule, marked) in enumerate(FAMILIES[family]):
        text, spans = plain(marked)
        for kind, a, b in spans or [(None, None, None)]:
            cells = ("NULL", "NULL", "NULL", "NULL") if kind is None else (quoted(kind), str(a), str(b), quoted(text[a:b]))
            out.append(f"({i}, {quoted(rule)}, {', '.join(cells)})")
    return 'SELECT case_id::BIGINT AS case_id, rule, type, start::INT AS start, "end"::INT AS "end", value FROM (VALUES ' + ", ".join(out) + ') t(case_id, rule, type, start, "end", value)'


#: (rule, text, spans of the rules, candidates of the model as (type, value, score), expected (type, reason, value) or an error)
MERGES = [
    ("M05", "Анна Белова пришла", [("PERSON", "Анна Белова")], [("PERSON", "Анна Белова", 0.9)], [("PERSON", "rule", "Анна Белова")]),
    ("M06", "звонила Xolani Radebe", [], [("PERSON", "Xolani Radebe", 0.5), ("PERSON", "Xolani Radebe", 0.8)], [("PERSON", "ner-person", "Xolani Radebe")]),
    ("M07", "почта a . serov@example . net", [], [("EMAIL", "a . serov@example . net", 0.8)], [("EMAIL", "ner-structured", "a . serov@example . net")]),
    ("M04", "коротко", [], [("PERSON", "коротко", 1.5)], "temporarily_unavailable"), ("M02", "Уфа", [], [("CITY", "Уфа", 0.5)], "temporarily_unavailable"),
    ("M08", "Клиент Шолохова Вера", [], [("PERSON", "Клиент Шолохова Вера", 0.8)], [("PERSON", "ner-person", "Шолохова Вера")]), ("M08", "отдел кадров", [], [("PERSON", "кадров", 0.8)], []), ("M08", "поэт Степан Мирошников", [], [("PERSON", "Степан Мирошников", 0.8)], []),
    ("M09", "Клиент Лесной ждёт", [("PERSON", "Клиент Лесной")], [("PERSON", "Клиент", 0.8)], [("PERSON", "rule", "Клиент Лесной")]),
    ("M10", "дебетовая карта и Омск", [], [("LOCATION", "дебетовая", 0.8), ("LOCATION", "Омск", 0.7)], [("LOCATION", "ner-location", "Омск")]),
    ("M11", "Номер заказа: 79991112233", [], [("PHONE", "79991112233", 0.8)], []), ("M11", "Паспорт: 1234567890", [], [("PHONE", "1234567890", 0.8)], []), ("M11", "Полис ОМС: 1234 5678 9012 3456", [], [("OMS", "1234 5678 9012 3456", 0.8)], [("OMS", "ner-structured", "1234 5678 9012 3456")]),
    ("M12", "документ 4509 123456", [("PASSPORT", "4509 123456")], [("DRIVER_LICENSE", "4509 123456", 0.8)], [("DRIVER_LICENSE", "ner-document-kind", "4509 123456")]),
    ("M12", "паспорт 4509 123456", [("PASSPORT", "4509 123456")], [("DRIVER_LICENSE", "4509 123456", 0.8)], [("PASSPORT", "rule", "4509 123456")]),
    ("M13", "живёт: ул. Лесная 5", [("STREET", "Лесная")], [("LOCATION", "ул. Лесная 5", 0.8)], [("LOCATION", "ner-location", "ул."), ("STREET", "rule", "Лесная"), ("LOCATION", "ner-location", "5")]),
    ("M14", "тел. +7 999 555-01-02, +7 999 555-03-04", [("PHONE", "+7 999 555-01-02, +7 999 555-03-04")], [("PHONE", "+7 999 555-01-02", 0.8), ("PHONE", "+7 999 555-03-04", 0.8)], [("PHONE", "rule", "+7 999 555-01-02"), ("PHONE", "rule", "+7 999 555-03-04")]),
]


def merge_rows() -> list[tuple]:
    at = lambda t, v: (t.index(v), t.index(v) + len(v))
    return [(i, rule, t, [(*at(t, v), k, 0.9, "rule") for k, v in base], [(*at(t, v), k, c, "model") for k, v, c in model]) for i, (rule, t, base, model, _) in enumerate(MERGES)]


def merge_values() -> str:
    out = []
    for i, (rule, _, _, _, want) in enumerate(MERGES):
        found = [(None, None, None)] if isinstance(want, str) or not want else want
        for row in found:
            cells = ", ".join("NULL" if x is None else quoted(x) for x in (*row, want if isinstance(want, str) else None))
            out.append(f"({i}, {quoted(rule)}, {cells})")
    return "SELECT case_id::BIGINT AS case_id, rule, type, reason, value, error FROM (VALUES " + ", ".join(out) + ") t(case_id, rule, type, reason, value, error)"


def marked_rows() -> list[tuple[str, str]]:
    return [(f"{family}-{i}", marked) for family, rows_ in FAMILIES.items() for i, (_, marked) in enumerate(rows_)]


def marked_values() -> str:
    out = []
    for case, marked in marked_rows():
        text, spans = plain(marked)
        for kind, a, b in spans or [(None, None, None)]:
            out.append(f"({quoted(case)}, {quoted(text)}, {'NULL' if kind is None else quoted(kind)}, {'NULL' if a is None else a}, {'NULL' if b is None else b})")
    return 'SELECT case_id, text, type, start::INT AS start, "end"::INT AS "end" FROM (VALUES ' + ", ".join(out) + ') t(case_id, text, type, start, "end")'
