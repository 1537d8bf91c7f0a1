"""Words, labels and cues that decide what counts as personal data.

In the lists phrases are separated by |, a blank stands for any run of blanks, ~ for any ending, ё also for е.
"""

from __future__ import annotations

# Given names (forms are made by rule in names.py), surnames without a typical ending, endings of surnames and patronymics.
GIVEN = (
    "иван петр пётр александр алексей андрей антон артём артем артур борис вадим валентин валерий василий виктор виталий владимир владислав вячеслав геннадий георгий глеб григорий даниил данил денис дмитрий "
    "евгений егор игорь илья кирилл константин лев леонид максим марк матвей михаил никита николай олег павел роман руслан семён семен сергей станислав степан тимофей тимур фёдор федор юрий ярослав "
    "алёна алена александра алина алиса алла анастасия анна валентина валерия варвара вера вероника виктория галина дарья диана ева евгения екатерина елена елизавета жанна зоя инна ирина карина кристина "
    "ксения лариса лидия любовь людмила маргарита марина мария надежда наталья наталия нина оксана олеся ольга полина раиса светлана софия софья тамара татьяна ульяна юлия яна"
).split()
GIVEN_ENDINGS = "а у ом е ой ы и ю я".split()
RARE_SURNAMES = "ким цой мороз волк лебедь заяц журавль шмидт гоголь блок даль дюма толстых белых чёрных черных".split()
RARE_ENDINGS = ("", "а", "у", "ом", "е")
SURNAME_ENDINGS = "ов ев ёв ин ын ский ская цкий цкая енко ко их ых ович евич ян дзе швили".split()
SURNAME_CASES = "а у ым ом е ой ую ого ому".split()
PATRONYMIC_MALE, PATRONYMIC_MALE_CASES = ("ович", "евич"), ("", "а", "у", "ем", "е")
PATRONYMIC_FEMALE = "овна овны овне овну овной евна евны евне евну евной инична иничны иничне иничну".split()
# Latin names: English given names, letters of the two usual transliterations, surname endings, words that look like names.
ENGLISH_GIVEN = "john peter alexander alex alexis andrew anthony arthur boris george gregory daniel eugene nicholas paul philip michael mary helen elizabeth julia katherine sophia victoria".split()
LATIN_LETTERS = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i i k l m n o p r s t u f kh ts ch sh shch ie y _ e iu ia".split()))
LATIN_LETTERS_2 = {"ё": "yo", "й": "y", "ъ": "", "ю": "yu", "я": "ya"}
LATIN_SURNAME_ENDINGS = "ov ev in yn sky ski skiy skii skyi skaya tsky tski enko ko ich yan dze shvili".split()
LATIN_NOT_NAMES = "login signin admin plugin origin domain skin checkin begin token version confirm confirmation media company corporate client holder unknown none null unavailable name card".split()
FIELD_GIVEN = (
    "әділ әлібек нұрлан айгүл айгерім ерлан болат асқар данияр азамат рустам тимур аліксандр олександр олег андрій петро микола володимир дмитро тарас богдан "
    "james robert david richard william charles anne jane sarah emily adam mohammed muhammad ali ahmed omar wei ming hua jun min lin вэй мин хуа цзюнь лин"
).split()
# Words that are no part of a name, of any record, and of a holder's field.
NOT_NAMES = "клиент клиентка получатель плательщик отправитель фио нет не указан указана указано неизвестен неизвестна отсутствует отсутствуют банк банка общество компания организация отдел ооо ао пао сотрудник заёмщик заемщик пациент поэт писатель зовут это и господин госпожа уважаемый уважаемая".split()
NOT_HOLDERS = (
    "карта карты имя держатель держателя банковская банковский пластиковая пластиковой подтвердил подтвердила обратился обратилась ввел ввёл ввела указал указала получил получила запросил запросила ип тест успешно "
    "выполнен выполнена операция операции платёж платеж перевод ожидает подтверждает позвонил ответил отказался заполняет согласился проверяет сообщил подписывает прочитал отправил вчера сегодня завтра заявку "
    "заявление данные согласие отказ доступ запрещен запрещён разрешен разрешён пользователь новый новая другой другая сторона текст значение подпись проверка ожидание реквизиты "
    "card holder name unknown none unavailable null not specified confirmed confirms successful operation payment transaction verification pending information details authorized person customer user legal entity "
    "access denied granted the is are was were has have will must to for from with by at of on in and or this that account action login number received requested approved rejected declined company corporate bank ltd llc inc called returned arrived checked signed submitted verified contacted waiting yesterday today tomorrow юридическое"
).split()
NOT_HOLDER_STEMS = "неизвестн~|отсутствующ~|компани~|организаци~|отдел~|департамент~|отделени~|управлени~|служб~"
PROSE = "обратился|обратилась|обратились|подтвердил|подтвердила|подтвердили|запросил|запросила|запросили|предъявил|предъявила|предъявили|сообщил|сообщила|сообщили|подписал|подписала|подписали|получил|получила|получили|оформил|оформила|оформили|заявил|заявила|заявили|ввёл|ввела|ввели|код назначения|код назначения платежа"
MISSING = "не указан|не указана|не указано|не известен|не известна|отсутствует"

# Months, ordinals of written dates and tens.
MONTHS = ("янв|январь|января", "фев|февраль|февраля", "мар|март|марта", "апр|апрель|апреля", "май|мая", "июн|июнь|июня", "июл|июль|июля", "авг|август|августа", "сен|сент|сентябрь|сентября", "окт|октябрь|октября", "ноя|ноябрь|ноября", "дек|декабрь|декабря")
ORDINALS = "перв втор треть четвёрт пят шест седьм восьм девят десят одиннадцат двенадцат тринадцат четырнадцат пятнадцат шестнадцат семнадцат восемнадцат девятнадцат двадцат".split()
TENS = "двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split()
TENTHS = "тридцат сороков пятидесят шестидесят семидесят восьмидесят девяност".split()
CENTURIES = {"тысяча восемьсот": 1800, "тысяча девятьсот": 1900, "две тысячи": 2000}

# Abbreviations whose dot ends no sentence.
ABBREVIATIONS = "г гор ул д кв корп стр обл р-н им пос тел гг ао пр просп пер наб бул дер п с сер ном гл".split()

# Labels of numbers.
PHONE = "телефон|тел.|мобильный|моб.|phone"
CARD = "номер карты|номер банковской карты|банковская карта|карта|card|pan"
CARD_END = "последние 4 цифры карты|последние четыре цифры карты|последние 4 цифры номера карты|последние четыре цифры номера карты|последние 4 цифры банковской карты|последние четыре цифры банковской карты|последние 4 цифры номера банковской карты|последние четыре цифры номера банковской карты"
BANK_CARD = "банковской карты|банковской карте|банковской картой|банковскую карту|банковская карта"
CVV = "cvv|cvv2|cvc|cvc2|cid|сvv|сvv2|сvc|сvc2|цвв|си-ви-ви|си ви ви|код безопасности"
CVV_BACK = "код на обороте карты|кода на обороте карты|код на обратной стороне карты|кода на обратной стороне карты"
PIN = "пин|pin"
CODE_TAIL = "код|code|карты|кода"
ORDER_OF_CARD = "первой карты|второй карты|третьей карты|основной карты|дополнительной карты|карты"
INN = "инн"
INN_OWNERS = "физлица|физического лица|клиента|сотрудника|заёмщика|поручителя|ип|банка|компании|организации|юрлица|юридического лица"
SNILS = "снилс"
INDEX = "индекс|индекса|индексу|индексом|индексе"
DEPARTMENT = "код|код подразделения|к/п|к п"
DEPARTMENT_SAID = "стоит|указан|записан|равен|составляет"
PASSPORT = "паспорт|паспорта|паспорт рф|паспорта рф|серия"
LICENSE = "водительск~ удостоверени~|в/у|в у|ву"
FOREIGN = "загранпаспорт|загранпаспорта|иностранный паспорт|вид на жительство|внж"
BIRTH_CERTIFICATE = "свидетельство о рождении"
COUNTRIES = {
    "kz": "казахстан|казахстана|республика казахстан|республики казахстан|рк|kz", "ua": "украина|украины|україна|україни|ukraine|ua", "uz": "узбекистан|узбекистана|республика узбекистан|республики узбекистан|uzbekistan|uz",
    "kg": "кыргызстан|кыргызстана|киргизия|киргизии|кыргызская республика|кыргызской республики|kg", "by": "беларусь|беларуси|республика беларусь|республики беларусь|белоруссия|белоруссии|рб|belarus|by",
    "md": "молдова|молдовы|республика молдова|республики молдова|молдавия|молдавии|moldova|md", "az": "азербайджан|азербайджана|республика азербайджан|республики азербайджан|azerbaijan|az",
}
#: (type, labels, country, value, whether the country may be missing)
REGIONAL = (
    ("INN", "иин|жсн|иин/жсн|жсн/иин", "kz", "[0-9]{12}", True), ("INN", "рнокпп", "ua", "[0-9]{10}", True), ("INN", "іпн", "ua", "[0-9]{10}", True), ("INN", "пинфл|jshshir|pinfl", "uz", "[0-9]{14}", True),
    ("INN", "пин|персональный идентификационный номер", "kg", "[0-9]{14}", False), ("INN", "idnp", "md", "[0-9]{13}", False),
    ("FOREIGN_DOCUMENT", "удостоверение личности|удостоверения личности|номер удостоверения личности|id-карта|id карта|id card|id-card|жеке куәлік", "kz", "[0-9]{9}", False),
    ("FOREIGN_DOCUMENT", "паспорт|паспорта|номер паспорта|id-карта|id карта|id-картка|id картка|id card|id-card", "ua", "[0-9]{9}", False),
    ("FOREIGN_DOCUMENT", "личный номер|идентификационный номер|персональный номер", "by", "[a-zA-Z0-9]{14}", False), ("FOREIGN_DOCUMENT", "fin|fın|fi̇n|фин", "az", "[a-zA-Z0-9]{7}", False),
)
ORDER_NUMBERS = "номер заказа|номер заявки|номер накладной|номер поставки|номер тикета|номер инцидента|идентификатор заказа|идентификатор заявки|id заказа|id заявки|артикул|артикул товара|sku|order id|order_id|order-id|ticket id|ticket_id|ticket-id|тикет|заказ|накладная"
OWN_NUMBERS = "телефон|тел|мобильн~|phone|инн|карта|карты|card|pan"

# Owners of records and cues.
CORPORATE = "ооо|пао|оао|зао|ао|компани~|организаци~|юрлиц~|юридическ~ лиц~|поставщик~|контрагент~"
PRIVATE = "клиент~|сотрудник~|физлиц~|физическ~ лиц~|заёмщик~|поручител~|ип"
PUBLIC_INN = "банка|компании|организации|юрлица|юридического лица"
PERSONAL_RECORD = "клиент~|пациент~|заёмщик~|сотрудник~|фио|зовут|заявител~|владелец~|договор~|паспорт~|получатель~"
PUBLIC_FIGURE = "поэт|поэта|поэту|поэтом|поэте|писатель|писателя|писателю|писателем|писателе|композитор|композитора|композитору|композитором|композиторе|стихотворение|стихотворения|стихотворении|стихи|стихов|цитат~|творчество|творчества|памятник|имени"
PUBLIC_WORK = "роман|романа|роману|романом|романе|поэма|поэмы|поэму|поэме|произведение|произведения|произведении"
PUBLIC_RECORD = "поэт|поэта|поэту|поэтом|писатель|писателя|стихотворение|стихотворения|роман|цитат~|творчество|творчества|памятник|имени|пушкин~"
PRAISE, PROFESSION = "русский|русская|советский|советская|великий|великая|известный|известная|знаменитый|знаменитая", "поэт|поэтесса|писатель|писательница|композитор|драматург"
STREET_CUE = "улица|улице|улицы|ул.|проспект|проспекте"
OFFICE_PLACE, OFFICE_OWNER = "отделение|отделения|отделении|отделению|филиал~|офис~|банкомат~", "банка|банк|сбербанка|альфа|втб"
HOME_PLACE = "прожива~|регистраци~|прописка|прописки|прописке|домашн~|личн~|клиент~"
POET = "поэт~|писател~|композитор~"
DATE_OWNER_PUBLIC, DATE_OWNER_PRIVATE = "поэт~|писател~|композитор~|банка|компании|организации", "клиент~|пациент~|заёмщик~|вкладчик~|сотрудник~|представител~|директор~|поручител~"
DATE_OTHER = "не указан~|не заполнен~|не предоставлен~|неизвест~|отсутств~|ожидается|нет|дата|релиз~|срок~"
# Whose a number is: kinds of owners, the last one before the number counts.
NUMBER_OWNERS = {
    "other_card": "тахографическ~ карточк~ водителя|топливн~ карточк~ водителя|корпоративн~ карточк~ водителя|коммерческ~ карточк~ водителя|карта водителя|карты водителя|карту водителя|картой водителя|карте водителя|водительская карта|водительской карты|водительскую карту",
    "driver_card": "карточк~ водителя|водительск~ карточк~", "license": "водительск~ удостоверени~|в/у|в у|ву|права", "passport": "паспортн~ данн~|паспортн~ реквизит~|паспорт|паспорта|паспортом|паспорте|документ|документа|документом|документе",
    "business": "пенсионн~ удостоверени~|служебн~ удостоверени~|студенческ~ удостоверени~|заказ~|накладн~|товар~|артикул~|договор~|контракт~|счёт~|издели~|оборудовани~|станк~|партия|партии|платёж~|сумм~|сертификат~|техническ~|транспортн~|телефон~|инн|снилс|id|sku|студенческ~|служебн~|пенсионн~|тахограф~|топлив~|оплат~|устройств~|принтер~|сканер~|компьютер~|ноутбук~|двигател~|автомобил~|удостоверение сотрудника|удостоверение качества|удостоверение соответствия",
    "identity": "удостоверение|удостоверения|удостоверение личности|удостоверения личности",
}
CLAUSE_WORDS = "клиента заявителя водителя владельца представителя проверен проверено проверена предъявлен предъявлено предъявлена получен получено получена принят принято принята оформлен оформлено оформлена зарегистрирован зарегистрировано".split()
FIELD_WORDS = "в на пункте поле графе разделе строке странице обороте ней нем нём указан указана указано указаны записан записана записано записаны приведён приведен приведено приведены содержится содержатся что".split()
SHOWING_WORDS = "его её ее их следующие данные реквизиты значение номер вот".split()
RECORD_SWITCH = "новая запись|новая анкета|новая заявка|новая операция|другая запись|другая анкета|другая заявка|другая операция|следующая запись|следующая анкета|следующая заявка|следующая операция"
PURPOSE = "для|при|с целью|в целях"
REQUESTED = "нужны|необходимы|требуются|потребуются"
BUSINESS_TAIL = "товара|заказа|оборудования|изделия|договора|контракта|партии|сертификата"
NONPERSONAL = "оборудовани~|издели~|техническ~|компани~|организаци~|транспортн~|объект~|проект~|станк~|здани~"
DOCUMENT_HOLDERS = "рф|клиента|клиент|заёмщика|поручителя|водителя|владельца|гражданина"
DOCUMENT_STOPS = "паспорт|в/у|в у|водительское|заказ~|товар~|накладн~|сертификат~|талон~|договор~|счёт~|телефон~|инн"
ISSUED_OTHER = "|".join([s + e for s in "талон товар чек сертификат заказ билет пропуск".split() for e in ("", "а", "у", "ом", "е")] + "накладная накладную накладной накладные накладных справка справку справки справке справкой".split())
MODEL_OWNERS = {
    "INN": "инн", "CARD": "карта|карты|карту|карте|card|pan", "PHONE": "телефон~|тел.|мобильн~|phone", "PASSPORT": "паспорт~", "DRIVER_LICENSE": "водительск~ удостоверени~|в/у|в у|права", "SNILS": "снилс", "OMS": "омс",
    "MILITARY_ID": "военн~ билет~", "BIRTH_CERTIFICATE": "свидетельств~ о рождении",
}

# Labels of names.
NAME_FIELDS, NAME_FIELD_PATRONYMIC = "фио|фамилия|имя", "отчество"
NAME_ROLES = "клиент|клиентка|клиента|клиенту|заёмщик|заёмщика|созаёмщик|созаёмщика|плательщик|плательщика|отправитель|отправителя|получатель|получателя|поручитель|поручителя|залогодатель|залогодателя|закладатель|закладателя|бенефициар|бенефициара|доверенное лицо|заявитель|заявителя|подателем заявки|доверенность оформлена на"
NAME_RECORDS = "фио|ф.и.о.|ф. и. о.|клиент|клиентка|клиенту|клиента|заёмщик|заёмщика|сотрудник|сотрудника|получатель|пациент|пациентка|владелец|заявитель|меня зовут|имя и фамилия|фамилия и имя"
NAME_FULL = "фио|фамилия и имя|имя и фамилия|аты-жөні|аты жөні"
NAME_OTHER = "гражданство|место рождения|дата рождения|дата выдачи|адрес|паспорт|телефон|инн|код|номер"
NAME_ORGANIZATION = "банк~|компани~|организаци~|юрлиц~|юридическ~ лиц~|предприяти~"
HOLDER = "имя держателя|имя держатель|имя держателя карты|держатель карты|держателя карты|эмбоссированное имя|card holder|cardholder|name on card|карта выпущена на имя|карта оформлена на имя"
HOLDER_ROLE = "держатель|держателя"
HOLDER_NUMBER = "номер карты|карта|карты|карту|card|card number"
CLIENT_ROLE = "клиент|клиентка|клиентки|клиентку|клиентке|клиенткой|клиента|клиенту|клиентом|клиенте|клиенты|клиентов|клиентам|клиентами|клиентах"
UNIT_HEAD, UNIT = "отдел|управление|департамент", "полиции|милиции|кадров|продаж|закупок|безопасности"
CARD_ATTRIBUTE, BANK_PRODUCT = "дебетов~|кредитн~|платёжн~|зарплатн~|виртуальн~|банковск~", "сейфов~ яче~|расчётн~ счёт~|текущ~ счёт~"

# Labels of dates and places.
BIRTH_DATE = "дата рождения|дата рожденья|др.|д.р.|д. р.|родился|родилась|рождён|рождена|день рождения"
BIRTH_DATE_FIELD, ISSUE_DATE_FIELD = "дата рождения", "дата выдачи паспорта|паспорт выдан"
BIRTH_DATE_TAIL = "рождения|г.р.|г. р.|гр."
ISSUE_DATE = "дата выдачи|дата выдачи паспорта|паспорт выдан|выдан|выдана|выдано"
ISSUED = "выдан|выданный|выданная|выданное|выданные|выданного|выдана|выдано"
RELATIVE_YEAR = "прошлом|позапрошлом|этом|текущем"
BIRTH_PLACE = "место рождения|родился в|родилась в"
NEXT_FIELD = "паспорт|телефон|email|e-mail|инн|код подразделения|дата выдачи|дата рождения|гражданство|адрес|родился|родилась|снилс|карта|фио|номер карты"
CITIZENSHIP = "гражданство|гражданин|гражданка"
STATES = "российская федерация|российское|россия|россию|россии|рф|ссср|сша|беларусь|беларуси|казахстан|казахстана|украина|украины|узбекистан|узбекистана|таджикистан|таджикистана|кыргызстан|кыргызстана|киргизия|киргизии|армении|германии|израиля|турции|франции"
COUNTRY = "страна|страна проживания"
CITY = "город|город проживания|город рождения|город регистрации|г."
STREET = "улица|ул.|проспект|пр-т|переулок|пер.|бульвар|бул.|набережная|наб.|шоссе"
HOUSE, APARTMENT, BUILDING = "дом|д.", "квартира|кв.", "корпус|корп.|к.|строение|стр."
STREET_HEADS = "улица|ул|проспект|просп|пр-т|пр-кт|переулок|пер|шоссе|набережная|наб|бульвар|бул|б-р|проезд|аллея|площадь|пл|микрорайон|мкр"
PLACE_STOPS = "д|дом|корп|корпус|к|стр|строение|кв|квартира|лит|литера|г|город|телефон|паспорт|email|инн|заказ|домофон"
UNITS = "корпус|корп|к|строение|стр|литера|литер|лит|квартира|кв"
LOCALITIES = "город|г|посёлок|пос|пгт|село|с|деревня|дер|д"
REGIONS, REPUBLIC = "область|обл.|край|район|р-н|г.о.|с.п.", "республика"
ADDRESS = "адрес|адрес проживания|адрес регистрации|адрес доставки|адрес клиента|адрес заёмщика|адрес банка|адрес отделения банка|адрес филиала банка|прописан|прописана|зарегистрирован|зарегистрирована|проживаю|проживает|живёт"
ADDRESS_STOPS = "паспорт|телефон|email|инн|дата рождения|гражданство|номер карты|фио"
ADDRESS_HINTS = "ул.|улиц|дом|д.|кв.|квартир|проспект|пр-т|переулок|шоссе|корпус|набережн"
REGISTRATION, REGISTERED = "место регистрации", "заёмщика|клиента|пациента|заявителя|поручителя"
FIELD_SCAFFOLD = ("регистраци", "проживани", "прописк", "бенефициар", "указано", "по адресу")
PLACE_PROSE = "подтвержден паспортом|подтверждена паспортом|подтверждено паспортом|подтвержден документом|подтверждена документом|подтверждено документом|анкета проверена|анкета подписана|анкета заполнена|оформил договор|оформила договор|оформили договор|совпадает с указанным"
SECOND_ADDRESS = "адрес проживания|адрес фактического проживания|адрес регистрации|продавец по адресу|покупатель по адресу|заёмщик по адресу|продавец - по адресу|покупатель - по адресу|заёмщик - по адресу|продавец — по адресу|покупатель — по адресу|заёмщик — по адресу"
PUBLIC_PLACE, PRIVATE_PLACE = "ооо|пао|оао|зао|ао|банк~|офис~|филиал~|компани~|организаци~|юрлиц~|юридическ~ лиц~", "клиент~|заёмщик~|пациент~|поручител~|проживани~|домашн~"
PERSONAL_CONTEXT = "паспорт|паспорта|паспорту|паспортом|паспорте|выдан~|выдал~|клиент~|заявител~|получател~|прожива~|зарегистрирован~|место рождения|орган выдачи|адрес|мой|моя"
OFFICES = "овд|увд|гвд|уфмс|оуфмс|фмс|мвд|умвд|отдел внутренних дел"
ADDRESS_MARKS = "ул.|улица|улицы|проспект|пр-т|пр.-т|пер.|переулок|шоссе|ш.|проезд|бульвар|наб.|набережная|площадь|пл.|дом|д.|корпус|корп.|строение|стр.|квартира|кв.|город|г.|село|деревня|пос.|посёлок|область|обл.|район|р-н|край|республика"

# Issuers of passports.
AUTHORITIES = "мвд|умвд|увд|овд|гвд|мвд|фмс|уфмс|офмс|оуфмс|гу мвд|у мвд|мо мвд|паспортно-визов~ отдел~|паспортно-визов~ служб~|отдел~ внутренних дел"
AUTHORITY_HEADS = "отдел|отделение|отделением|отделом|управление|управления|управлением"
ISSUER_SHORT = "кем выдан|орган|орган выдачи|орган выдавший паспорт|орган, выдавший паспорт|паспорт выдан|выдан"
ISSUER_FIELD = "орган выдачи|орган выдачи паспорта|орган, выдавший паспорт|кем выдан паспорт"
REISSUE = "повторный выдан|повторный паспорт выдан|повторный был выдан|повторный паспорт был выдан|повторный —|повторный паспорт —|повторный -|повторный паспорт -"
ISSUED_TO = "гражданину|гражданке|клиенту|клиентке|заявителю|заявительнице"
ISSUER_CONTEXT = "выданный|выданные|выданная|выданное|выданного|выдан|выдана|выдано|выдал|выдала|орган выдачи"
ISSUER_NEXT = "код подразделения|дата выдачи|дата рождения|повторный|телефон|адрес|фио|паспорт"
ISSUER_PROSE = "совпадает|подтверждён|подтверждена|подтверждено|подтверждены|указан|указана|указано|указаны|выдал|выдала|выдало|в прошлом году|в текущем году|в этом году|в позапрошлом году"
AUTHORITY_MISSING = "не указан~|не извест~|не определён~|неизвест~|отсутств~|нет данных|обратит~|обратиться|уточнит~|уточнить"
