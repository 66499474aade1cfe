"""Contracts of the raw exports and the processed tables."""

from __future__ import annotations

# Columns that raw exports must have, by the names used here.
RAW_ORDERS = {
    "OrderIdsMindboxId": "order_id",
    "OrderFirstActionDateTimeUtc": "event_time",
    "OrderFirstActionChannelName": "store",
    "OrderLineProductIdsOffline1C": "code_ru",
    "OrderLineProductIdsKanzlerKz": "code_kz",
    "OrderLineQuantity": "qty",
    "OrderLineBasePricePerItem": "base_price",
    "OrderLinePriceOfLine": "line_amount",
    "OrderCustomerLastActivatedCardIdsNumber": "card_no",
    "OrderCustomerIdsMindboxId": "customer_id",
    "OrderCustomerFirstName": "first_name",
    "OrderCustomerLastName": "last_name",
    "OrderCustomerMiddleName": "middle_name",
    "OrderCustomerBirthDate": "birth_date",
    "OrderCustomerSex": "sex",
    "OrderCustomerEmail": "email",
    "OrderCustomerMobilePhone": "phone_1",
    "OrderCustomerPendingMobilePhone": "phone_2",
    "OrderCustomerCustomFieldsMostViewedCategory": "cat_1",
    "OrderCustomerCustomFieldsMostViewedRootCategory": "cat_2",
    "OrderCustomerCustomFieldsMostViewedSubsidiaryCategory": "cat_3",
}
_ACTION = {
    "CustomerActionDateTimeUtc": "event_time",
    "CustomerActionProductsIdsOffline1C": "code_ru",
    "CustomerActionProductsIdsKanzlerKz": "code_kz",
    "CustomerActionCustomerLastActivatedCardIdsNumber": "card_no",
    "CustomerActionCustomerIdsMindboxId": "customer_id",
    "CustomerActionCustomerFirstName": "first_name",
    "CustomerActionCustomerLastName": "last_name",
    "CustomerActionCustomerMiddleName": "middle_name",
    "CustomerActionCustomerBirthDate": "birth_date",
    "CustomerActionCustomerSex": "sex",
    "CustomerActionCustomerEmail": "email",
    "CustomerActionCustomerMobilePhone": "phone_1",
    "CustomerActionCustomerPendingMobilePhone": "phone_2",
    "CustomerActionCustomerCustomFieldsMostViewedCategory": "cat_1",
    "CustomerActionCustomerCustomFieldsMostViewedRootCategory": "cat_2",
    "CustomerActionCustomerCustomFieldsMostViewedSubsidiaryCategory": "cat_3",
}
RAW_VIEWS = _ACTION | {"CustomerActionProductCategoriesIdsOffline1C": "category_code"}
RAW_FAVORITES = _ACTION | {"CustomerActionActionTemplateIdsSystemName": "operation"}
# Fixed value: the operation that sets a whole list of favourites, not one item.
SET_OPERATION = "DobavlenieProduktaVSpisokVOperaciiUstanovka"

# Headers of the processed tables in files, by the names used here.
HEADERS = {
    "Дата": "event_date",
    "НомерЗаказа": "order_id",
    "Магазин": "store",
    "КодНоменклатуры": "item_code",
    "Номенклатура": "item_name",
    "ВидНоменклатуры": "item_kind",
    "НазваниеНаСайте": "site_name",
    "Количество": "qty",
    "НачальнаяЦена": "base_price",
    "НачальнаяСтоимость": "base_amount",
    "КонечнаяСтоимость": "line_amount",
    "ПроцентСкидки": "discount_pct",
    "Валюта": "currency",
    "ДисконтнаяКарта": "card_no",
    "MindboxID": "customer_id",
    "ФИО": "full_name",
    "ДатаРождения": "birth_date",
    "Возраст": "age",
    "ВозрастнаяГруппа": "age_group",
    "ПолКлиента": "sex",
    "Почта": "email",
    "Телефон": "phone",
    "ЛюбимаяКатегория": "fav_category",
    "ТипТовара": "item_type",
    "ВидАссортимента": "assortment",
    "Марка": "brand",
    "Коллекция": "collection",
    "СезонНоски": "season",
    "ПолНоменклатуры": "item_sex",
    "ГруппаСоставов": "composition",
    "КатегорияНаСайте": "site_category",
    "СтилеваяГруппа": "style_group",
    "ТитульнаяФотография": "photo",
    "КодКатегории": "category_code",
    "НазваниеКатегории": "category_name",
    "КодРодительскойКатегории": "parent_code",
}
_ITEM = ["item_code", "item_name", "site_name", "item_kind", "assortment", "brand", "collection", "season", "item_sex", "composition", "site_category", "style_group", "photo"]
_CATEGORY = ["category_code", "category_name", "parent_code"]
_BY_NAME = {v: k for k, v in HEADERS.items()}
RAW_ITEMS = {_BY_NAME[c]: c for c in _ITEM}
RAW_CATEGORIES = {_BY_NAME[c]: c for c in _CATEGORY}

_PERSON = ["card_no", "customer_id", "full_name", "birth_date", "age", "age_group", "sex", "email", "phone", "fav_category"]
COLUMNS = {
    "orders": ["event_date", "order_id", "store", "item_code", "item_name", "item_kind", "site_name", "qty", "base_price", "base_amount", "line_amount", "discount_pct", "currency", *_PERSON],
    "views": ["event_date", "item_code", "item_name", "item_kind", "site_name", "category_name", "item_type", *_PERSON],
    "favorites": ["event_date", "item_code", "item_name", "item_kind", "site_name", *_PERSON],
    "items": _ITEM,
    "categories": _CATEGORY,
}
#: Kind of dataset: separator of its raw export, and the columns that it must have.
RAW = {
    "orders": (";", RAW_ORDERS),
    "views": (";", RAW_VIEWS),
    "favorites": (";", RAW_FAVORITES),
    "items": ("|", RAW_ITEMS),
    "categories": ("|", RAW_CATEGORIES),
}
