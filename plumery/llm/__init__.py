"""Operations of a training-data pipeline on documents and vectors, each a function from DataFrames to DataFrames."""
