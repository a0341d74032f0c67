"""Operations of a training-data pipeline: tokens, deduplication, mixing, sharding, filters."""
