"""Operations of a training-data pipeline: ten operators, each in its own module, and their registered queries."""
