"""Link-analysis operators over DataFrames."""
