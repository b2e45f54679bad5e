"""Operations of a training-data pipeline.  Nothing else in lexispark imports this subpackage."""
