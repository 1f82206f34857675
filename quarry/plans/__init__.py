"""What queries need around their plans: shipping, scratch tables, frontiers."""
