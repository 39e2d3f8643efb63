"""Operations of a training-data pipeline over large document tables. Nothing else in the library imports this package."""
