"""Place intelligence on Spark: registers in, scored and described places out."""
