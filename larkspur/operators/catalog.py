"""The vocabulary of four business domains, as a table.

Metrics have a label, a unit, the direction in which they are worse, and other names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Metrics of retail.
RETAIL = (
    ("sales_volume", "Объём продаж", "units", "neutral", "sales quantity|продажи|объем продаж|реализация|кол-во продаж"),
    ("revenue", "Выручка", "KZT", "lower_is_worse", "sales revenue|turnover|выручка|оборот"),
    ("gross_profit", "Валовая прибыль", "KZT", "lower_is_worse", "валовая прибыль"),
    ("gross_margin", "Валовая маржа", "%", "lower_is_worse", "gross margin %|маржа|валовая маржа"),
    ("average_selling_price", "Средняя цена продажи", "KZT", "neutral", "avg selling price|средняя цена продажи"),
    ("units_sold", "Продано единиц", "units", "neutral", "sold qty|продано|продано, ед|количество проданных единиц"),
    ("demand", "Спрос", "units", "neutral", "спрос|demand quantity"),
    ("inventory", "Товарный запас", "units", "neutral", "stock|balance|остаток|остатки|товарный запас"),
    ("stockout_rate", "Доля дефицита", "%", "higher_is_worse", "stockout %|дефицит|дефицит, %"),
    ("inventory_turnover", "Оборачиваемость запасов", "index", "neutral", "stock turnover|оборачиваемость запасов|оборот запасов"),
    ("days_inventory", "Дни запаса", "days", "neutral", "days of inventory|дни запаса"),
    ("returns_rate", "Доля возвратов", "%", "higher_is_worse", "return rate|returns %|возвраты, %|доля возвратов"),
    ("discount_rate", "Размер скидки", "%", "neutral", "discount %|скидка|скидка, %"),
    ("conversion_rate", "Конверсия", "%", "lower_is_worse", "conversion %|конверсия|конверсия, %"),
    ("average_order_value", "Средний чек", "KZT", "neutral", "AOV|avg order value|средний чек"),
    ("customer_count", "Количество покупателей", "count", "neutral", "customers count|количество покупателей"),
    ("repeat_purchase_rate", "Доля повторных покупок", "%", "lower_is_worse", "repeat purchase %|доля повторных покупок"),
    ("procurement_cost", "Стоимость закупки", "KZT", "higher_is_worse", "procurement costs|purchase cost|стоимость закупки|затраты на закупку"),
    ("logistics_cost", "Логистические затраты", "KZT", "higher_is_worse", "logistics costs|логистические затраты"),
    ("lead_time", "Срок поставки", "days", "higher_is_worse", "срок поставки|время поставки"),
)
#: Metrics of logistics.
LOGISTICS = (
    ("shipment_volume", "Объём отгрузки", "units", "neutral", "shipment qty|объем отгрузки|отгружено|кол-во отгружено"),
    ("delivered_qty", "Поставленное количество", "units", "neutral", "delivered quantity|delivered volume|поставлено|кол-во поставлено"),
    ("on_time_delivery_rate", "Доля своевременных поставок", "%", "lower_is_worse", "OTD|доля своевременных поставок"),
    ("lead_time", "Срок поставки", "days", "higher_is_worse", "срок поставки"),
    ("transit_time", "Время в пути", "hours", "higher_is_worse", "время в пути|срок перевозки"),
    ("logistics_cost", "Логистические затраты", "KZT", "higher_is_worse", "logistics costs|логистические затраты"),
    ("freight_cost", "Стоимость перевозки", "KZT", "higher_is_worse", "freight costs|стоимость перевозки|фрахт"),
    ("fuel_cost", "Стоимость топлива", "KZT", "higher_is_worse", "fuel costs|стоимость топлива"),
    ("warehouse_inventory", "Складской запас", "units", "neutral", "warehouse stock|складской запас"),
    ("warehouse_utilization", "Загрузка склада", "%", "neutral", "warehouse utilization %|загрузка склада"),
    ("order_fulfillment_rate", "Доля выполненных заказов", "%", "lower_is_worse", "fulfillment %|доля выполненных заказов"),
    ("fill_rate", "Полнота исполнения", "%", "lower_is_worse", "fill %|полнота исполнения"),
    ("backorder_qty", "Отложенные заказы", "units", "higher_is_worse", "backorder quantity|отложенные заказы"),
    ("stockout_rate", "Доля дефицита", "%", "higher_is_worse", "stockout %|дефицит, %"),
    ("damaged_goods_rate", "Доля повреждённых товаров", "%", "higher_is_worse", "damaged goods %|доля поврежденных товаров"),
    ("route_distance", "Расстояние маршрута", "km", "neutral", "расстояние маршрута|длина маршрута"),
    ("vehicle_utilization", "Загрузка транспорта", "%", "neutral", "vehicle utilization %|загрузка транспорта"),
    ("delivery_delay", "Задержка доставки", "days", "higher_is_worse", "задержка доставки|просрочка доставки"),
    ("supplier_lead_time", "Срок поставщика", "days", "higher_is_worse", "срок поставщика"),
    ("eta_accuracy", "Точность прогноза прибытия", "%", "lower_is_worse", "ETA accuracy|точность прогноза прибытия|точность ETA"),
    ("pod_completion_rate", "Доля подтверждённых доставок", "%", "lower_is_worse", "POD rate|proof of delivery rate|доля подтверждённых доставок|доля POD"),
)
#: Metrics of manufacturing.
MANUFACTURING = (
    ("production_volume", "Объём производства", "units", "neutral", "production qty|объем производства|выпуск"),
    ("planned_production", "План производства", "units", "neutral", "production plan|план производства|плановый выпуск"),
    ("actual_production", "Факт производства", "units", "neutral", "production actual|факт производства|фактический выпуск"),
    ("production_gap", "Разрыв производства", "units", "higher_is_worse", "разрыв производства|дефицит выпуска"),
    ("throughput", "Пропускная способность", "units/h", "neutral", "production throughput|пропускная способность"),
    ("cycle_time", "Время цикла", "hours", "higher_is_worse", "время цикла"),
    ("downtime", "Простой", "hours", "higher_is_worse", "простой|простои|downtime hours"),
    ("unplanned_downtime", "Внеплановый простой", "hours", "higher_is_worse", "внеплановый простой|аварийные простои"),
    ("equipment_utilization", "Загрузка оборудования", "%", "neutral", "equipment utilization %|загрузка оборудования"),
    ("oee", "Эффективность оборудования OEE", "%", "lower_is_worse", "overall equipment effectiveness|общая эффективность оборудования|ОЕЕ"),
    ("defect_rate", "Доля брака", "%", "higher_is_worse", "defect %|доля брака|брак, %"),
    ("scrap_rate", "Доля отходов", "%", "higher_is_worse", "scrap %|доля отходов"),
    ("yield_rate", "Выход годной продукции", "%", "lower_is_worse", "yield %|выход годной продукции"),
    ("raw_material_inventory", "Запас сырья", "units", "neutral", "raw material stock|запас сырья"),
    ("finished_goods_inventory", "Запас готовой продукции", "units", "neutral", "finished goods stock|запас готовой продукции"),
    ("energy_consumption", "Потребление энергии", "kWh", "neutral", "энергопотребление|потребление энергии"),
    ("maintenance_cost", "Затраты на обслуживание", "KZT", "higher_is_worse", "maintenance costs|затраты на обслуживание"),
    ("labor_productivity", "Производительность труда", "units/person/h", "lower_is_worse", "labour productivity|производительность труда|выработка"),
    ("unit_cost", "Себестоимость единицы", "KZT/unit", "higher_is_worse", "unit costs|себестоимость единицы"),
    ("order_backlog", "Портфель невыполненных заказов", "units", "neutral", "невыполненные заказы|портфель заказов"),
)
#: Metrics of mining.
MINING = (
    ("ore_production", "Добыча руды", "t", "neutral", "ore output|добыча руды|добыча|руда добытая"),
    ("waste_moved", "Перемещённая вскрыша", "t", "neutral", "waste movement|вскрыша|горная масса перемещенная"),
    ("stripping_volume", "Объём вскрышных работ", "m3", "neutral", "stripping qty|объем вскрышных работ"),
    ("crushing_volume", "Объём дробления", "t", "neutral", "crushed tonnes|дробление|объем дробления|ДСК объем дробления"),
    ("processing_volume", "Объём переработки", "t", "neutral", "processed tonnes|переработка|объем переработки"),
    ("recovery_rate", "Коэффициент извлечения", "%", "lower_is_worse", "recovery %|коэффициент извлечения|извлечение, %"),
    ("ore_grade", "Содержание в руде", "%", "neutral", "ore content|содержание руды|содержание в руде"),
    ("concentrate_grade", "Содержание в концентрате", "%", "neutral", "concentrate content|содержание концентрата"),
    ("equipment_downtime", "Простой оборудования", "hours", "higher_is_worse", "equipment downtime hours|простой оборудования|простои"),
    ("crusher_downtime", "Простой дробилки", "hours", "higher_is_worse", "crusher downtime hours|простой дробилки|простои ДСК"),
    ("conveyor_downtime", "Простой конвейера", "hours", "higher_is_worse", "conveyor downtime hours|простой конвейера"),
    ("haulage_cycle_time", "Цикл самосвала", "hours", "higher_is_worse", "truck cycle time|цикл самосвала|время рейса"),
    ("truck_utilization", "Загрузка самосвала", "%", "neutral", "truck utilization %|загрузка самосвала"),
    ("excavator_utilization", "Загрузка экскаватора", "%", "neutral", "excavator utilization %|загрузка экскаватора"),
    ("fuel_consumption", "Расход топлива", "liters", "neutral", "diesel consumption|расход ГСМ|расход дизтоплива|расход топлива"),
    ("explosive_consumption", "Расход взрывчатых материалов", "kg", "neutral", "explosives consumption|расход взрывчатых материалов|расход ВМ|БВР расход ВМ"),
    ("plant_throughput", "Производительность фабрики", "t/h", "lower_is_worse", "plant productivity|производительность фабрики|производительность ДСК"),
    ("stockpile_inventory", "Запас руды", "t", "neutral", "ore stock|склад руды|запас в штабеле"),
    ("maintenance_hours", "Время обслуживания", "hours", "neutral", "время обслуживания|часы ремонта"),
    ("production_plan", "План добычи", "t", "neutral", "ore plan|план добычи"),
    ("production_actual", "Факт добычи", "t", "neutral", "ore actual|факт добычи"),
    ("production_gap", "Разрыв добычи", "t", "higher_is_worse", "ore gap|разрыв добычи|отставание добычи"),
)
#: What marks a domain: strong and characteristic metrics, and outcomes.
MARKS = {
    "RETAIL": {"strong": ["units_sold", "average_order_value", "repeat_purchase_rate"], "characteristic": ["sales_volume", "gross_margin", "inventory", "conversion_rate"], "outcome": ["stockout_rate", "returns_rate", "gross_margin"]},
    "LOGISTICS": {"strong": ["on_time_delivery_rate", "shipment_volume", "vehicle_utilization"], "characteristic": ["transit_time", "freight_cost", "route_distance", "order_fulfillment_rate"], "outcome": ["on_time_delivery_rate", "delivery_delay", "damaged_goods_rate"]},
    "MANUFACTURING": {"strong": ["oee", "defect_rate", "finished_goods_inventory"], "characteristic": ["planned_production", "actual_production", "cycle_time", "scrap_rate"], "outcome": ["production_gap", "defect_rate", "oee"]},
    "MINING": {"strong": ["ore_production", "ore_grade", "recovery_rate", "crusher_downtime"], "characteristic": ["waste_moved", "crushing_volume", "processing_volume", "haulage_cycle_time"], "outcome": ["production_gap", "recovery_rate"]},
}
#: The fewest metrics that make a domain eligible, and its least lead over the next.
LEAST_MATCH, LEAST_LEAD = 3, 3
#: Families of units.
UNIT_FAMILIES = {"%": "PERCENTAGE", "pp": "PERCENTAGE", "KZT": "CURRENCY", "hours": "HOURS", "days": "DAYS", "count": "COUNT", "people": "COUNT"}

DOMAINS = {"RETAIL": RETAIL, "LOGISTICS": LOGISTICS, "MANUFACTURING": MANUFACTURING, "MINING": MINING}


def metrics() -> list[tuple]:
    """(domain, metric, label, unit, family, direction, names, strong, characteristic, outcome)."""
    rows = []
    for domain, table in DOMAINS.items():
        marks = MARKS[domain]
        for name, label, unit, direction, others in table:
            rows.append((domain, name, label, unit, UNIT_FAMILIES.get(unit, ""), direction, [name, *filter(None, others.split("|"))], *(name in marks[m] for m in ("strong", "characteristic", "outcome"))))
    return rows


def catalog(spark: SparkSession) -> DataFrame:
    """One row a metric of a domain."""
    return spark.createDataFrame(metrics(), "domain string, metric string, label string, unit string, family string, direction string, names array<string>, strong boolean, characteristic boolean, outcome boolean")


def aliases(spark: SparkSession) -> DataFrame:
    """One row for each name of a metric; no metric of these domains excludes its domain."""
    return catalog(spark).select("domain", "metric", F.explode("names").alias("alias"), "strong", "characteristic", "outcome", F.lit(False).alias("excluded"))


def concepts(spark: SparkSession) -> DataFrame:
    """The metrics as concepts that columns may be resolved to."""
    return catalog(spark).select("domain", F.col("metric").alias("concept"), F.array_distinct(F.concat(F.array("metric", "label"), "names")).alias("texts"), F.slice("names", 2, 1000).alias("aliases"), F.lit("NUMERIC").alias("data_type"), "family", F.lit(False).alias("exact_only"))


def hints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, LEAST_MATCH, LEAST_LEAD) for d in DOMAINS], "domain string, minimum_match int, minimum_margin int")
