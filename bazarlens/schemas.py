"""Table schemas as DDL text. Timestamps carry no zone, money is double."""

ORDERS = "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz"
ORDER_ITEMS = "order_id string, product_id string, price double, freight_value double"
PRODUCTS = "product_id string, product_category_name string"
TRANSLATION = "product_category_name string, product_category_name_english string"
ORDER_REVIEWS = "review_id string, order_id string, review_score int, review_comment_message string"
CUSTOMERS = (
    "customer_id string, customer_unique_id string, customer_city string, customer_state string, customer_zip_code_prefix int"
)
GEOLOCATION = "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double"
CLASSIFIED = (
    "review_id string, order_id string, review_score int, review_comment_message string, pain_point_category string"
)
SEGMENTED = "customer_unique_id string, recency long, frequency long, monetary double, segmento string"
KNOWLEDGE_BASE = (
    "version string, descripcion string, total_productos long, productos array<struct<"
    "id: string, categoria: string, nombre: string, descripcion: string, precio_promedio_real: double, "
    "rango_precios: struct<minimo: double, maximo: double>, unidades_vendidas: long, destacado: boolean, "
    "tags: array<string>>>"
)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"

# File names of the CSV form of the data set.
CSV_FILES = {
    "orders": ("orders_dataset.csv", ORDERS),
    "items": ("order_items_dataset.csv", ORDER_ITEMS),
    "products": ("products_dataset.csv", PRODUCTS),
    "translation": ("product_category_name_translation.csv", TRANSLATION),
    "reviews": ("order_reviews_dataset.csv", ORDER_REVIEWS),
    "customers": ("customers_dataset.csv", CUSTOMERS),
    "geolocation": ("geolocation_dataset.csv", GEOLOCATION),
}
# Loaded and profiled only; their columns are read as text.
PROFILE_ONLY_FILES = {
    "payments": "order_payments_dataset.csv",
    "sellers": "sellers_dataset.csv",
}
