"""Two people with readings on consecutive days, for tests and demonstrations."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from tarnlake.schemas import conform


def profiles(spark: SparkSession) -> DataFrame:
    common = {"gender": "Nam", "diabetes_type": "Loại 2", "insulin_schedule": "Buổi sáng và buổi tối", "treatment_method": "Insulin + thuốc uống", "past_diseases": ["Tăng huyết áp"], "lifestyle": "Ăn nhiều rau, ít tinh bột, đi bộ 30 phút mỗi ngày"}
    rows = [
        common | {"_id": "1", "user_id": "user_001", "patient_id": "P001", "full_name": "Nguyễn Văn A", "age": 65, "bmi": 24.5, "complications": ["Bệnh võng mạc"]},
        common | {"_id": "2", "user_id": "user_002", "patient_id": "P002", "full_name": "Trần Thị B", "age": 58, "gender": "Nữ", "bmi": 23.8, "complications": ["Bệnh thần kinh"]},
    ]
    kinds = "_id string, user_id string, patient_id string, full_name string, age int, gender string, bmi double, diabetes_type string, insulin_schedule string, treatment_method string, complications array<string>, past_diseases array<string>, lifestyle string"
    return conform(spark.createDataFrame(rows, kinds), "user_profiles")


def readings(spark: SparkSession, anchor: datetime) -> DataFrame:
    values = {
        "user_001": [("Đường huyết", None, [9.2, 8.7, 9.5]), ("Huyết áp", "tâm thu", [145.0, 142.0]), ("Huyết áp", "tâm trương", [90.0, 90.0])],
        "user_002": [("Đường huyết", None, [7.8, 8.1, 7.6]), ("Huyết áp", "tâm thu", [138.0, 135.0]), ("Huyết áp", "tâm trương", [85.0, 85.0])],
    }
    rows = [
        (f"{user}-{number}-{day}", user, "P" + user[-3:], kind, v, "mmol/l" if subtype is None else "mmHg", subtype, anchor - timedelta(days=day))
        for user, kinds in values.items()
        for number, (kind, subtype, series) in enumerate(kinds)
        for day, v in enumerate(series)
    ]
    return conform(spark.createDataFrame(rows, "_id string, user_id string, patient_id string, type string, value double, unit string, subtype string, timestamp timestamp"), "health_records")
