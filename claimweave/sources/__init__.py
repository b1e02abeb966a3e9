"""Where facts and pages come from and go to."""
